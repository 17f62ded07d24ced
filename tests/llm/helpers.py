"""Small tables with every awkward row: nulls, empty and long texts, repeats, and columns whose names operators use inside."""

from __future__ import annotations

CLASH = {"row_id": "x", "h": "y", "size": 7, "score": 0.5, "y": 3, "n": 1, "digest": "z", "found": 2, "comp": 1, "node": 4}
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in the wood today"
ODD = [None, "", " \n\t ", "one", "two words", "é", "x" * 3000, PLAIN, PLAIN, PLAIN.upper(), (PLAIN + "\n") * 9, " ".join(f"w{i}" for i in range(4000))]


def documents(spark, rows, clash=True):
    """Rows (doc_id, text, lang, source) with n_chars, and clashing columns unless told otherwise."""
    extra = CLASH if clash else {}
    kinds = {str: "string", int: "int", float: "double"}
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", {k} {kinds[type(v)]}" for k, v in extra.items())
    data = [(i, t, la, s, len(t) if t is not None else None, *extra.values()) for i, t, la, s in rows]
    return spark.createDataFrame(data, schema)


def odd_documents(spark):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(ODD)]
    return documents(spark, [*rows, rows[-3], (None, PLAIN, None, None), (50, None, None, None)])


def no_documents(spark):
    return documents(spark, [])
