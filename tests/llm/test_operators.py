"""Every operator against brute force on a small table with nulls, empty, tied, repeated and long rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import decontamination, fertility, language, lines, minhash, packing, personal, sharding, substrings, suffixes
from leafspan.llm.common import keyed

WORDS = [f"w{i}x" for i in range(400)]


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 13, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 8 & 255 if seed % 2 else state >> 9 & 127] + ("\n" if i % 9 == 8 else ""))
    return " ".join(out).replace("\n ", "\n")


PASSAGE = prose(101, 40)
LONG = prose(5, 9000)
TEXTS = [
    prose(1, 120), prose(2, 120), prose(1, 120), prose(3, 60) + "\n" + PASSAGE, prose(4, 60) + "\n" + PASSAGE + "\ntail", None, "", " \n\t ", "one",
    "two words", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a " * 8, LONG, "é" * 300, "x\n\nx\nshort", "one",
    prose(1, 60) + " changed " + " ".join(prose(1, 120).split()[61:]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), i, 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, shard int").repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, equal rows, null columns."""
    rows = [(None, PASSAGE, None), (1, PASSAGE, None), (1, PASSAGE, None), (1, None, "en"), (2, "", None), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string"))


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def removed_units(texts: list[list], size: int) -> list[list[bool]]:
    seen, out = set(), []
    for units in texts:
        flags = [False] * len(units)
        for i in range(len(units) - size + 1):
            window = tuple(units[i : i + size])
            if window in seen:
                flags[i : i + size] = [True] * size
            seen.add(window)
        out.append(flags)
    return out


def test_keys_follow_document_order(odd):
    rows = sorted(keyed(odd).collect(), key=lambda r: r["key"])
    assert len({r["key"] for r in rows}) == 6
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1, 2]


def test_substrings(docs, odd):
    words = [(t or "").encode().split() for t in TEXTS]
    got = by_id(substrings.remove_repeats(docs))
    for i, flags in enumerate(removed_units(words, 20)):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(flags), sum(flags))
        assert got[i]["kept"].encode() == b" ".join(w for w, f in zip(words[i], flags) if not f)
    assert sorted(r["n_removed"] for r in substrings.remove_repeats(odd).collect()) == [0, 0, 0, 0, 40, 40]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_suffixes(docs, batches):
    data = [(t or "").encode() for t in TEXTS]
    got = by_id(suffixes.remove_repeated_bytes(docs, batches=batches))
    for i, flags in enumerate(removed_units(data, 100)):
        assert got[i]["n_removed"] == sum(flags), i
        assert got[i]["kept"] == bytes(b for b, f in zip(data[i], flags) if not f)


def test_suffixes_with_odd_rows_and_crowded_anchors(spark, odd):
    assert sorted(r["n_removed"] for r in suffixes.remove_repeated_bytes(odd).collect())[-2:] == [len(PASSAGE)] * 2
    assert suffixes.remove_repeated_bytes(odd.limit(0)).count() == 0
    line = "A boilerplate line that many documents share, of eighty bytes or somewhat more, yes."
    texts = [prose(200 + i, 8) + line + prose(300 + i % 90, 12) for i in range(180)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffixes.remove_repeated_bytes(docs))
    for i, flags in enumerate(removed_units([t.encode() for t in texts], 100)):
        assert got[i]["n_removed"] == sum(flags)


@pytest.mark.parametrize("batches", [1, 4])
def test_suffixes_with_a_phrase_repeated_nearby(spark, batches):
    draw = np.random.default_rng(11)
    some = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    twice, once = [], []
    for i in range(60):
        phrase, between, after = some(40), some(4 + i % 20), some(90)
        twice.append(some(90) + phrase + between + phrase + after)
        once.append(some(90) + between + phrase + after)
    texts = [t for i, pair in enumerate(zip(twice, once)) for t in (pair if i % 2 else pair[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(suffixes.remove_repeated_bytes(docs, batches=batches))
    for i, flags in enumerate(removed_units([t.encode() for t in texts], 100)):
        assert got[i]["n_removed"] == sum(flags), i


def test_lines(docs, odd):
    seen = set()
    got = by_id(lines.remove_lines(docs))
    for i, text in enumerate(TEXTS):
        all_lines = (text or "").split("\n") if text is not None else []
        seq = [j for j, x in enumerate(all_lines) if x.split()]
        gone = set()
        for a in range(len(seq)):
            total, b = 0, a
            while b < len(seq) and total < lines.MIN_WORDS:
                total, b = total + len(all_lines[seq[b]].split()), b + 1
            if total >= lines.MIN_WORDS:
                run = tuple(all_lines[j] for j in seq[a:b])
                if run in seen:
                    gone.update(seq[a:b])
                seen.add(run)
        kept = "\n".join(x for j, x in enumerate(all_lines) if j not in gone) if text is not None else None
        assert (got[i]["n_lines"], got[i]["n_removed"], got[i]["kept"]) == (len(all_lines), len(gone), kept), i
    assert lines.remove_lines(odd).count() == 6
    assert lines.remove_lines(docs.limit(0)).count() == 0


def test_whole_repeated_passages(spark):
    draw = np.random.default_rng(4)
    texts = ["one two three four five six\nthe end\nfirst", "one two three four five six\nthe end\nsecond", *TEXTS]
    texts += ["\n".join(" ".join("ab"[draw.integers(2)] for _ in range(draw.integers(0, 4))) for _ in range(draw.integers(1, 14))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, seen = by_id(lines.remove_lines(docs, whole=True)), set()
    for i, text in enumerate(texts):
        all_lines = (text or "").split("\n") if text is not None else []
        seq, gone = [j for j, x in enumerate(all_lines) if x.split()], set()
        # Every run of any length that starts earlier; no run of fewer lines is taken for it.
        for a in range(len(seq)):
            runs = [tuple(all_lines[j] for j in seq[a:b]) for b in range(a + 1, min(len(seq), a + 60) + 1)]
            for run in runs:
                if run in seen and sum(len(x.split()) for x in run) >= lines.MIN_WORDS:
                    gone.update(seq[a : a + len(run)])
            seen.update(runs)
        kept = "\n".join(x for j, x in enumerate(all_lines) if j not in gone) if text is not None else None
        assert (got[i]["n_removed"], got[i]["kept"]) == (len(gone), kept), i
    assert got[1]["kept"] == "second"


def test_pipeline_removes_whole_passages(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(0, "one two three four five six\nthe end\nfirst"), (1, "one two three four five six\nthe end\nsecond")], "doc_id long, text string")
    assert by_id(corpus_pipeline.repeated_lines(spark, docs, ""))[1]["text"] == "second"


def test_decontamination_blocks_agree_with_brute_force(spark, docs, odd):
    items = [(1, " ".join(PASSAGE.split()[5:25])), (2, "Two WORDS"), (2, "Two WORDS"), (3, None), (None, "one"), (4, " . "), (10, " ".join(PASSAGE.split()[10:22]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    one = by_id(decontamination.report(decontamination.contamination(docs, bench)))
    many = by_id(decontamination.report(decontamination.contamination(docs, bench, block_words=30)))
    for i, text in enumerate(TEXTS):
        words, hit, found = split(text), set(), set()
        for item, content in items:
            w = split(content)
            if item is None or not w:
                continue
            n = min(10, len(w))
            grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in grams:
                    hit.update(range(a, a + n))
                    found.add(str(item))
        want = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
        for got in (one, many):
            assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
    clean = decontamination.remove_spans(docs, bench)
    assert clean.columns == docs.columns and 9 not in by_id(clean)
    again = decontamination.remove_spans(docs, bench, block_words=30)
    assert {(r["doc_id"], r["text"]) for r in clean.collect()} >= {(r["doc_id"], r["text"]) for r in again.collect() if r["text"]}
    assert decontamination.contamination(odd, bench).count() == 6


def test_removed_spans_do_not_depend_on_blocks(spark, monkeypatch):
    items = [(i, prose(400 + i, 12)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None if i % 3 == 0 else i % 7, f"{prose(500 + i, 30)} {items[i % 6][1] if i % 2 else ''} end{i}", "x" * (i * 37 % 900)) for i in range(120)]
    rows += [(None, items[0][1], "gone"), (1, None, "null"), (1, None, "null"), (2, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(5)
    calls, once = [], decontamination.keyed
    monkeypatch.setattr(decontamination, "keyed", lambda *a, **b: calls.append(1) or once(*a, **b))
    whole = decontamination.remove_spans(docs, bench)
    cut = decontamination.remove_spans(docs, bench, block_words=30)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(cut) == plain(whole) and len(plain(whole)) == len(rows) - 1
    # A second numbering of the rows need not be the same.
    assert len(calls) == 1


def test_packing(docs, odd):
    capacity = 256
    pieces = packing.pack(docs, packing.public_vocabulary(), capacity, with_ids=True).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_vocabulary())
    ids = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        own = list(memoryview(bytes(r["ids"])).cast("I"))
        assert len(own) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == len(ids.get(r["doc_id"], []))
        ids.setdefault(r["doc_id"], []).extend(own)
    for i, text in enumerate(TEXTS):
        assert ids[i] == whole.encode(text or "", add_special_tokens=False).ids + [1]
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    bins = []
    for length in sorted((r["length"] for r in pieces), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= length]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= length
        else:
            bins.append(capacity - length)
    assert len(held) == len(bins)
    assert packing.pack(odd, packing.public_vocabulary()).count() == 6
    assert packing.pack(docs.limit(0), packing.public_vocabulary()).count() == 0


def test_best_fit_plan_equals_one_by_one():
    state = 5
    for _ in range(60):
        lengths = []
        for _ in range(80):
            state = (state * 1103515245 + 12345) % (1 << 31)
            lengths.append(1 + (state >> 8) % 30)
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= n
            else:
                bins.append(30 - n)
        runs, count = packing.best_fit_plan(dict(Counter(lengths)), 30)
        assert count == len(bins) and sum(r.count for r in runs) == len(lengths)


def test_minhash_classes(spark, odd):
    base = [prose(20 + i, 150).split() for i in range(3)]
    texts = [" ".join(b) for b in base] + [None, "", "tiny text", "tiny  text"]
    for i in range(60):
        words = list(base[i % 3])
        for j in range(1 + i % 4):
            words[(i * 17 + j * 31) % 150] = f"new{i}-{j}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit(0)).repartition(4)
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (texts[a] or "") == (texts[b] or "") or both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicate_classes(docs))
    assert {i: got[i]["class_key"] for i in got} == {i: root(i) for i in range(len(texts))}
    assert len({r["class_key"] for r in minhash.near_duplicate_classes(odd).collect()}) == 2
    assert minhash.near_duplicate_classes(docs.limit(0)).count() == 0


def test_blocks_join_what_all_pairs_join():
    draw = np.random.default_rng(3)
    base = [draw.choice(9000, 60, replace=False) for _ in range(3)]
    sets = []
    for i in range(70):
        changed = base[i % 3].copy()
        changed[draw.choice(60, draw.integers(0, 14), replace=False)] = draw.integers(9000, 9030)
        sets.append(np.unique(changed).astype("<u8"))
    rep, label = np.arange(70), np.arange(70)
    label[[9, 12, 15]] = 9

    def components(links):
        group = label.copy()
        for a, b in links:
            group[group == group[a]] = group[b]
        return {tuple(np.flatnonzero(group == g)) for g in np.unique(group)}

    near = [
        (a, b) for a in range(70) for b in range(a)
        if (both := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)
    ]
    block, links = rep % 4, []
    for low in range(4):
        for high in range(low, 4):
            rows = np.flatnonzero((block == low) | (block == high))
            found = [sets[i].tobytes() for i in rows]
            got = minhash.joining(rep[rows], label[rows], block[rows] == low, found, low == high, 0.8)
            assert all((b, a) in near for a, b in got) and len(got) < len(rows)
            links += got
    assert len(near) > len(links) and components(links) == components(near) and 3 < len(components(near)) < 70


@pytest.mark.parametrize("texts, shingles", [(5, 1_000_000), (512, 700)])
def test_minhash_classes_in_small_blocks(spark, monkeypatch, texts, shingles):
    # Copies of one text, of which many are nearer to it than to one another, and no text equal to it.
    base = prose(7, 120).split()
    rows = []
    for i in range(40):
        words = list(base)
        for j in range(2 + i % 5):
            del words[(i * 13 + j * 29) % len(words)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = by_id(minhash.near_duplicate_classes(docs))
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    cut = by_id(minhash.near_duplicate_classes(docs))
    assert {i: r["class_key"] for i, r in cut.items()} == {i: r["class_key"] for i, r in whole.items()}


def test_halves_of_a_digest_are_independent(spark):
    import struct

    import xxhash

    rows = spark.createDataFrame([(i, prose(800 + i, 20)) for i in range(5)], "key long, text string")
    for r in minhash._banded(rows, 5, 24, 4).collect():
        after = xxhash.xxh64_intdigest(struct.pack("<i", 17), seed=r["a"] % (1 << 64))
        assert r["b"] % (1 << 64) != after


def test_pipeline_keeps_texts_without_labels(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words", None), (2, "123 !?", None), (3, None, None), (4, "слова", None)], "doc_id long, text string, lang string")
    assert set(by_id(corpus_pipeline.language(spark, docs, ""))) == {1, 4}


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out())
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / total > 0.98
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and of")], "doc_id long, text string")
    got = by_id(language.predict(edge, language.fit(docs)))
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and 0 <= got[4]["score"] <= 1
    assert by_id(language.predict(edge, None))[4]["lang_pred"] == "und"
    assert language.identify(docs.limit(0)).count() == 0


def test_personal_data(spark, odd):
    texts = [
        "mail a.b@c.example.com, a@b@c.de x@y", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5", "4532 0151 1283 0366 and 4532-0151-1283-0367", "+1 (988) 555-2485 or +12",
        None, "", "@@ @a.b a@-.-", "é +49 30 1234567 ü b@c.de",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    patterns = {"email": personal.EMAIL, "ip": personal.IP, "card": personal.CARD, "phone": personal.PHONE}
    checks = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and personal.luhn(re.sub(r"\D", "", s)),
        "phone": lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15,
    }
    got = by_id(personal.find(docs))
    for i, text in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in p.finditer(text or "") if checks[k](m.group())]
        assert [tuple(s) for s in got[i]["base"]] == want
        assert {tuple(s) for s in got[i]["spans"]} >= set(want)
    weights = personal.fit([f"call +1 ({300 + i}) 555-{1000 + i} now or x{i}@mail.example.com ok version {i}.0 of 20{i:02d}" for i in range(60)])
    text = "reach me at (812) 555-1234 or jo [at] mail.example.com in 2024, page 12"
    added = {(k, text[a:b]) for k, a, b in personal.added_spans(text, weights, personal.base_spans(text))}
    assert ("phone", "(812) 555-1234") in added and not any(t in ("2024", "12") for _, t in added)
    assert personal.find(odd).count() == 6 and personal.find(docs.limit(0)).count() == 0


def test_sharding(docs, odd):
    for table in (docs.withColumn("size", F.lit(1)), odd):
        rows = sharding.shard(table, 4).collect()
        assert len(rows) == table.count()
        slots = {}
        for r in rows:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    got = by_id(sharding.shard(docs, 4))
    for i, text in enumerate(TEXTS):
        assert (got[i]["size"], got[i]["text_crc32"]) == (len((text or "").encode()) + 8, zlib.crc32((text or "").encode()))
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_sharding_is_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = [r["n"] for r in sharding.shard(docs).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 24 and max(sizes) < 1.03 * min(sizes)


def test_fertility(docs, odd):
    got = by_id(fertility.judge(docs, packing.public_vocabulary("piece_bpe_32k.model")))
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        three = Counter(tuple(words[a : a + 3]) for a in range(len(words) - 2))
        repeat = {a + k for a in range(len(words) - 2) if three[tuple(words[a : a + 3])] > 1 for k in range(3)}
        rows = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(repeat))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert fertility.judge(odd, packing.public_vocabulary("piece_bpe_32k.model")).count() == 6
    assert fertility.judge(docs.limit(0), packing.public_vocabulary("piece_bpe_32k.model")).count() == 0


def test_clean_documents_pass_the_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = fertility.judge(docs, packing.public_vocabulary("piece_bpe_32k.model")).where(~F.col("base_failed"))
    dropped, total = found.agg(F.sum((~F.col("kept")).cast("int")), F.count("*")).first()
    assert dropped / total < 0.02


def test_rare_characters_do_not_fail_documents(spark):
    texts = [prose(600 + i, 200) for i in range(60)] + [prose(700, 2000) + " \U0001F9FF", prose(701, 60) + " \U0001F9FF", "\U0001F9FF\U0001F9F6 " * 60 + prose(702, 60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = by_id(fertility.judge(docs, packing.public_vocabulary("piece_bpe_32k.model")))
    assert got[60]["byte_share"] > 0 and got[61]["byte_share"] > 0
    assert not {"byte_share", "base"} & {x for i in (60, 61) for x in got[i]["reasons"]}
    assert "byte_share" in got[62]["reasons"] or got[62]["base_failed"]
    # Copies give every measure a range of nothing.
    same = [(i, prose(600, 200) + (" other words" if i == 59 else ""), "en") for i in range(60)]
    got = by_id(fertility.judge(spark.createDataFrame(same, "doc_id long, text string, lang string"), packing.public_vocabulary("piece_bpe_32k.model")))
    assert got[59]["kept"], got[59]


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r["doc_id"] for r in rows}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 0.8 * docs.select("text").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ids
