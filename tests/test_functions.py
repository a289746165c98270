"""Edge rows of FIXTURES.md for the column expressions."""

from pyspark.sql import functions as F

from vetrina.functions import text as T
from vetrina.operators import extract as X
from vetrina.operators import labels as L
from vetrina.operators import slots as SL


def one(spark, col, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_capacity_c1(spark):
    got = one(spark, T.capacity, ["Eau 100ML x", "1.5 ml", "50 ml + 100 ml", "none", None, "Eau 30 Ml"])
    assert got == ["100 ml", "5 ml", "50 ml", None, None, "30 ml"]


def test_suffix_b9(spark):
    vals = ["u/#richSnippet", "u", "u/#richSnippet/x"]
    assert one(spark, T.strip_suffix, vals) == ["u", "u", "u/#richSnippet/x"]
    assert one(spark, T.strip_all, vals) == ["u", "u", "u/x"]


def test_parse_cap_e8a(spark):
    got = one(spark, T.parse_cap, ["<30", "< 30", None, "<x"])
    assert [None if g is None else float(g) for g in got] == [30.0, 30.0, None, None]


def test_decimal_guard_e8(spark):
    got = one(spark, T.decimal_or_null, ["12.5", "12,5", "1e1", "", " 7 "])
    assert [None if g is None else float(g) for g in got] == [12.5, None, None, None, 7.0]


def test_keywords_e1(spark):
    df = spark.createDataFrame([("Fragranze Donna", "Floreale", None, None, "<30")],
                               "category string, olfactory_category string, capacity string, brand string, "
                               "price string")
    r = df.select(T.to_keywords("category", "olfactory_category", "capacity", "brand", "price")).first()[0]
    assert r == "fragranze donna floreale minori di 30 euro"


def test_capitalise_e18(spark):
    assert one(spark, T.capitalise_words, ["  l'oréal  PARIS ", "d&g"]) == ["L'oréal Paris", "D&g"]


def test_ld_json_blocks_b2_b3(spark):
    html = ("<SCRIPT type='application/ld+json'>\n{\"@graph\":[{\"@type\":\"Product\",\"@id\":\"a\"}]}\n</SCRIPT>"
            "<script>{\"@graph\":[{\"@type\":\"Product\",\"@id\":\"plain\"}]}</script>"
            '<script type="application/ld+json">{"@graph": [</script>'
            '<script type="application/ld+json"></script>'
            '<script type="application/ld+json">[1, 2]</script>'
            '<script type="application/ld+json">{"@graph":[{"@type":["Product"]},{"@type":"Organization"},'
            '{"x":1},{"@type":"Product","@id":"b"}]}</script>')
    pages = spark.createDataFrame([("u", 200, html), ("v", 404, html)], "url string, status int, html string")
    prods, errors = X.extract_products(pages)
    assert sorted(r["id"] for r in prods.collect()) == ["a", "b"]
    errs = sorted((r["reason"], r["detail"]) for r in errors.collect())
    assert errs == [("json", "1"), ("json", "2"), ("json", "3"), ("status", "404")]


def test_big_block_b2(spark):
    body = '{"@graph":[' + ",".join('{"@type":"Product","@id":"p%d"}' % i for i in range(20000)) + "]}"
    html = '<html><script type="application/ld+json">' + body + "</script></html>"
    assert len(html) > 500_000
    pages = spark.createDataFrame([("u", 200, html)], "url string, status int, html string")
    prods, _ = X.extract_products(pages)
    assert prods.count() == 20000


def test_score_validation_c3(spark):
    ok = ['[["A", 1]]', "[['A', 1]]", '[["A",1],]', "[]", "[ [\"A\" , -1] , ['B', 0] ]"]
    bad = ['[["A", "1"]]', 'ecco: [["A", 1]]', '[["A"]]', '[["A",1] ["B",0]]', "", '["A",1]', None]
    assert one(spark, L.valid_scores, ok) == [True] * len(ok)
    assert one(spark, L.valid_scores, bad) == [False] * len(bad)
    long = "[" + ", ".join('["L%d", 1]' % i for i in range(2000)) + "]"
    assert one(spark, L.valid_scores, [long]) == [True]


def test_score_vectors_c5_c6_c7(spark):
    """Every reply gives every label of the domain, also the unusable ones."""
    df = spark.createDataFrame([(1, 'ecco: [["Dolce", 1]'), (2, ""), (3, "[['A', 1], ['B', 0],]"), (4, '[["A", +1]]'),
                                (5, '[["A", "1"]]'), (6, "[]"), (7, None), (8, '[["B", 1], ["B", 0], ["Z", 1]]')], "id long, reply string")
    rows = sorted((r["id"], r["valid"], r["label"], r["score"]) for r in L.scores(df, ["Dolce", "A", "B"]).collect())
    ones = {(1, "Dolce"), (3, "A"), (4, "A"), (5, "A")}
    valid = {3, 4, 6, 8}
    assert rows == sorted((i, i in valid, x, int((i, x) in ones)) for i in range(1, 9) for x in ("Dolce", "A", "B"))
    wide = {r["id"]: tuple(r)[1:] for r in L.one_hot(df, ["Dolce", "A", "B"]).collect()}
    assert wide == {i: tuple(int((i, x) in ones) for x in ("Dolce", "A", "B")) for i in range(1, 9)}
    assert sorted(r["id"] for r in L.malformed(df).collect()) == [1, 2, 5, 7]


def test_tagger_zero_vectors_c2(spark):
    docs = spark.createDataFrame([(1, "The cat"), (2, ""), (3, None), (4, "le chat " * 200 + "the")], "id long, text string")
    lex = spark.createDataFrame([("the", "en"), ("le", "fr"), ("x", "other")], "term string, label string")
    got = sorted(tuple(r) for r in L.tag_labels(docs, lex, ["en", "fr"]).collect())
    assert got == [(1, "en", 1), (1, "fr", 0), (2, "en", 0), (2, "fr", 0), (3, "en", 0), (3, "fr", 0), (4, "en", 1), (4, "fr", 1)]


def test_zero_pairs_c9(spark):
    df = spark.createDataFrame([(1, ["b", "a", "q"]), (2, None)], "id long, labels array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in L.pair_counts(df, domain=["a", "b", "c"]).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}


def test_label_pairs_c8(spark):
    got = one(spark, L.label_pairs, [["c", "a", "b"], ["a"], []], "array<string>")
    assert got == [["a b", "a c", "b c"], [], []]


def test_valid_slots_e16(spark):
    good = '[["brand", ""], ["category", "x"], ["capacity", "50 ml"], ["olfactory category", ""], ["price", "< 30"]]'
    cases = {
        good: True,
        good.replace('"50 ml"', '""'): True,
        good.replace('"50 ml"', '"50ml"'): False,
        good.replace('"< 30"', '"<30"'): False,
        good.replace(', ["price", "< 30"]', ""): False,
        "not a list": False,
    }
    assert one(spark, SL.valid_slots, list(cases)) == list(cases.values())


def test_pairs_to_query_e19(spark):
    df = spark.createDataFrame([('[["brand", "a"], ["category", "c"], ["brand", "b"], '
                                 '["olfactory category", "x"], ["price", ""]]',)], "reply string")
    r = df.select(*SL.pairs_to_query(SL.reply_pairs("reply"))).first()
    assert r["brand"] == "b" and r["olfactory_category"] == "x" and r["capacity"] is None


def test_html_to_text_b7(spark):
    html = "<p>a</p><!-- c --><script>x<y</script><p> b &amp; c</p>\n<b>d</b>"
    assert one(spark, T.html_to_text, [html, "plain", None]) == ["a  b & c \n d", "plain", None]


def test_html_to_text_many_tags_b7(spark):
    pages = ["<p>" * 20000 + "x" + "</p>" * 20000, "a<script>if (x<y) z", "<style>p{}", "x<!-- open", "<" * 3000]
    assert one(spark, T.html_to_text, pages) == ["x", "a", "", "x", "<" * 3000]


def test_character_references_b7(spark):
    text = ["perch&eacute; &euro;5 l&#8217;&#x41;", "&amp;lt; &bogus; & &", "&#0;&#xD800;&#1114112;", "&NotEqualTilde;", "no", None]
    want = ["perch\u00e9 \u20ac5 l\u2019A", "&lt; &bogus; & &", "\ufffd\ufffd\ufffd", "\u2242\u0338", "no", None]
    assert one(spark, T.html_to_text, text) == want


def test_prices_keep_digits_e8(spark):
    got = one(spark, T.decimal_or_null, ["29.99999", "123456789012345.25"])
    assert [str(g.normalize()) for g in got] == ["29.99999", "123456789012345.25"]


def test_reply_escapes_e16(spark):
    df = spark.createDataFrame([('a "b" c', "x\\y")], "brand string, category string")
    df = df.selectExpr("*", "'' capacity", "'' olfactory_category", "'' price")
    reply = df.select(SL.to_reply().alias("reply"))
    r = reply.select(SL.valid_slots("reply").alias("ok"), *SL.pairs_to_query(SL.reply_pairs("reply"))).first()
    assert r["ok"] and (r["brand"], r["category"]) == ('a "b" c', "x\\y")
    long = '[' + ', '.join(['["brand", "' + "\\\\" * 20000 + '"]'] * 5) + ']'
    assert one(spark, SL.valid_slots, [long]) == [True]


def test_long_phrase_e15(spark):
    vocab = spark.createDataFrame([("casa di moda del nord", "brand", "Casa di Moda del Nord"), ("moda", "category", "Moda")],
                                  "phrase string, slot string, value string")
    texts = spark.createDataFrame([("q", "moda Casa di moda del nord 50 ml")], "query_id string, text_query string")
    r = SL.fill_slots(texts, vocab).first()
    assert (r["brand"], r["category"], r["capacity"]) == ("Casa di Moda del Nord", "Moda", "50 ml")


def test_top_pairs_tie_c10(spark):
    # Eleven pairs with one row each: the 10 kept are the first 10 in pair order.
    labels = [["a", chr(ord("b") + i)] for i in range(11)]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "id long, labels array<string>")
    got = [r["pair"] for r in L.top_pairs(L.pair_counts(df, domain=None), 10).collect()]
    assert got == [f"a {chr(ord('b') + i)}" for i in range(10)]


def test_only_elements_are_blocks_b2(spark):
    def block(n):
        return '{"@graph":[{"@type":"Product","@id":"%s"}]}' % n

    html = (f'<!-- <script type="application/ld+json">{block("comment")}</script> --><script data-type="application/ld+json">{block("data")}</script>'
            f'<script type="application/ld+json-patch">{block("patch")}</script><a title=\'<script type="application/ld+json">{block("quoted")}</script>\'>x</a>'
            f'<script>var s = \'<script type="application/ld+json">{block("in script")}\';</script><textarea><script type="application/ld+json">{block("raw")}</script></textarea>'
            f'<!--><script id="a>b" async TYPE=application/ld+json>{block("good")}</script ><script type="a" type="application/ld+json">{block("last")}</script>'
            f'<p it\'s><script type = "application/ld+json" defer>{block("spaced")}</SCRIPT><script type="application/ld+json">{block("open")}')
    pages = spark.createDataFrame([("u", 200, html), ("e", 200, ""), ("n", 200, None)], "url string, status int, html string")
    blocks = X.ld_json_blocks(pages).collect()
    assert [(r["url"], r["block"]) for r in blocks] == [("u", 0), ("u", 1), ("u", 2), ("u", 3)]
    assert [r["id"] for r in X.extract_products(pages)[0].orderBy("block").collect()] == ["good", "last", "spaced", "open"]


def test_html_tokens_b7(spark):
    pages = ['<a title="x>y">z</a>', "<p it's>don't</p>", "a<!-->b<!--->c<!-- > -->d<!-- x --!>e", "<a href=x>1</a><a b='>'>2", '<a t="open>x', "3 < 4 > 2 <5",
             "<style media='>'>p{}</style>s<script>'</p>'</scripty></script >t", "<div " + "a='b' " * 5000 + ">x", "<a " + "=" * 20000 + ">y"]
    assert one(spark, T.html_to_text, pages) == ["z", "don't", "a b c d e", "1 2", "x", "3 < 4 > 2 <5", "s t", "x", "y"]


def test_references_like_the_standard_b7(spark):
    from html import unescape
    text = ["&copy 2020 &nbsp x", "&#146;&#x80;&#129;&#150", "&notit; &notin; &copyx &COPY &amp&amp", "&#65 &#x41g &#x; &#; &# &", "&lt;p&gt; &quot;&apos;", "&#1;&#11;&#127;&#xFFFE;&#xFDD0;&#13;",
            "&#99999999999999999999; &#x110000; &#0000000065;", "&aacute&eacute;&Eacutex", "&fjlig; &NotEqualTilde; &thetasym;", "a&b=c&amp;d&lang=x", "&" * 500, "&zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz;"]
    assert one(spark, T.char_references, text) == [unescape(t) for t in text]
