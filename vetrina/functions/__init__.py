from . import patterns, text, vocab  # noqa: F401
