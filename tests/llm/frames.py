"""Small corpora with the odd cases, and tables in a folder as queries read them."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, fp string, ids string, n_words string, kept string, part string"

WORDS = {
    "en": "the of and house river stone walks under green light paper window morning small bridge water garden answer quiet road".split(),
    "de": "der die und haus fluss stein geht unter grün licht papier fenster morgen klein brücke wasser garten antwort ruhig weg".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er"]) for _ in range(n)) + "."


def prose(rng, lang="en", sentences=8):
    return "\n".join(sentence(rng, lang, rng.randint(6, 14)).capitalize() for _ in range(sentences))


def odd_rows(seed=1):
    """Null id, null text, empty and blank texts, odd white space, a very long text and repeated rows."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "two words", "A b c  d\r\ne\x1cf", "日本語 テスト 😀 ½ ²", "<|endoftext|> <s>", "x" * 3000, " ".join(["again"] * 500), prose(rng), prose(rng, "de"), sentence(rng, "en", 60_000)]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[10], rows[10], (None, texts[10]), (None, None), (None, "")]


def docs_of(spark, rows):
    """Documents with columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 == 0 else None, None, None, 0.5, 7, "fp", "ids", "n", "kept", "part") for i, t in rows], SCHEMA)


def odd_docs(spark):
    return docs_of(spark, odd_rows())


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_row(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def count_ids(rows):
    return sorted((i is not None, i or 0) for i, _ in rows)


def ids_of(df, col="doc_id"):
    return sorted((r[0] is not None, r[0] or 0) for r in df.select(F.col(col)).collect())
