DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows, extra=None):
    """rows: (doc_id, text[, lang[, source]]); extra: columns to add, all of them strings."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra or ():
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


CLASHING = ["group_id", "key", "rep", "take", "n_tokens", "place", "h", "label", "a", "b", "words", "removed_words", "spans"]


def prose(seed, n, vocabulary=400):
    import random

    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
