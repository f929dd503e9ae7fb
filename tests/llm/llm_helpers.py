"""What several tests of the training-data operators share."""

import re

from txloom.llm import tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, pairs):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
