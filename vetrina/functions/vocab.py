"""Default domains of the shop catalogue.

Fixed values: the label names, categories, price caps and thresholds that the
evaluation uses by default. Every operator takes them as parameters, so other
catalogues (and the test tables) pass their own.
"""

# Thirteen scent labels, in the order the classifier lists them.
LABELS = [
    "Agrumato", "Ambrato", "Aromatico", "Chypre", "Cuoio", "Dolce", "Floreale",
    "Fruttato", "Gourmand", "Legnoso", "Muschiato", "Senza Profumo", "Speziato Leggero",
]

CATEGORIES = ["Fragranze Donna", "Fragranze Uomo"]
PRICE_CAPS = [20, 30, 40, 50, 75, 100]
TOP_CAPACITIES = 5
MIN_VALUES = 20
MIN_SUPPORT = 20
TOP_PAIR_COUNT = 10

# Feature names of a structured query, in the order queries are written.
FEATURES = ["brand", "category", "capacity", "olfactory_category", "price"]

# Property names written into product nodes by the enrichment step.
PROP_CAPACITY = "Capacita"
PROP_SCENT = "Gruppo Olfattivo"
