"""Outline judgement in rounds against one document after the other."""

from leafspan.operators import outline
from pyspark.sql import functions as F

SCHEMA = "doc_id string, pdf_id int, text string, text_level int, parent_id int"


class ByContext:
    """Levels that depend on how many titles the context shows, so that a wrong batch or context changes them."""

    GIVEN = f"struct<context:{outline.LISTED},titles:{outline.LISTED}>"

    def complete(self, prompt):
        given = F.from_json(F.substring_index(prompt, "Titles:\n", -1), self.GIVEN)
        shown = F.size(given["context"])
        told = F.transform(given["titles"], lambda t, i: F.struct(
            t["pdf_id"].alias("pdf_id"), F.when(t["text"] == "no", -1).otherwise((shown + i) % 3).alias("level"), F.lit(0).alias("parent_id")
        ))
        reply = F.to_json(F.struct(told.alias("outline")))
        return F.when(F.exists(given["titles"], lambda t: t["text"] == "break"), "no json").otherwise(reply)


def repaired(found):
    if found and not any(t["level"] == 0 for t in found):
        found[0]["level"] = 0
    top = next((t["id"] for t in found if t["level"] == 0), None)
    for t in found:
        if t["level"] != 0 and t["parent"] == 0:
            t["parent"] = top
    return found


def one_by_one(titles, words, most):
    found, at = [], 0
    size = lambda text: len(text.split()) + 1
    while at < len(titles):
        ones = [t for t in found if t["level"] == 1]
        tail = found[-5:]
        last = ones[-1]["id"] if ones else -1
        shown = {t["id"]: t for t in [t for t in found if t["level"] == 0] + ones[:3] + ones[-5:] + [t for t in tail if t["id"] >= last]}
        used, batch = sum(size(t["text"]) for t in shown.values()), []
        for t in titles[at : at + most]:
            if used + size(t[1]) > words:
                break
            used += size(t[1])
            batch.append(t)
        if not batch:
            at += 1
            continue
        if any(t[1] == "break" for t in batch):
            new = [{"id": i, "text": x, "level": level, "parent": parent} for i, x, level, parent in batch]
        else:
            new = [{"id": t[0], "text": t[1], "level": (len(shown) + n) % 3, "parent": 0} for n, t in enumerate(batch) if t[1] != "no"]
        found = repaired(found + new)
        at += len(batch)
    return [(t["id"], t["level"], t["parent"]) for t in found]


def test_equal_to_one_document_after_the_other(spark):
    docs = {
        "long": [(3 * i + 1, f"title {i}", 1 + i % 2, 0) for i in range(11)],
        "mixed": [(1, "a b", 0, 0), (2, "no", 1, 1), (5, "word " * 40, 1, 1), (6, "c", 1, 1), (7, "break", 2, 6), (9, "d e f", 1, 1)],
        "large": [(4, "word " * 60, 1, 0)], "one": [(2, "x", 1, 0)],
    }
    df = spark.createDataFrame([(d, *t) for d, titles in docs.items() for t in titles], SCHEMA)
    got = {}
    for r in outline.judge_in_rounds(df, ByContext(), words=45, most=4, rows=4).orderBy("doc_id", "pdf_id").collect():
        got.setdefault(r.doc_id, []).append((r.pdf_id, r.text_level, r.parent_id))
    assert got == {d: one_by_one(titles, 45, 4) for d, titles in docs.items() if one_by_one(titles, 45, 4)}
    assert "large" not in got and len(got["long"]) == 11
    assert outline.judge_in_rounds(df.limit(0), ByContext()).count() == 0
