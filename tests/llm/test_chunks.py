import numpy as np

from pyspark.sql import functions as F

from tablecraft.llm import chunks
from tablecraft.llm.bytehash import SPACE
from tests.llm.conftest import prose


def ends(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return list(chunks.cuts(data, np.array([0, len(data)])))


def brute_ends(data):
    """The cutting rule read byte by byte."""
    hits = []
    for i in range(chunks.GEAR_BITS - 1, len(data)):
        h = 0
        for b in data[i - 15:i + 1]:
            h = (2 * h + int(chunks._GEAR[b])) % 65536
        if SPACE[data[i]] and h < 65536 // chunks.CUT:
            hits.append(i + 1)
    hits = [h for k, h in enumerate(hits) if k == 0 or h - hits[k - 1] >= chunks.LEAST]
    out, at = [], 0
    for end in [*[h for h in hits if h < len(data)], len(data)]:
        first = at
        for k in range(first + chunks.MOST, end, chunks.MOST):
            while data[k] & 0xC0 == 0x80:
                k -= 1
            out.append(k)
        out.append(end)
        at = end
    return out


def brute(rows):
    """(id, kept text, sources) by comparing the chunks of all texts, ids without repeats."""
    pieces = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        cut = brute_ends(data) if data else []
        pieces[doc_id] = [data[a:b] for a, b in zip([0, *cut], cut)]
    first = {}
    for doc_id in sorted(pieces):
        for p in pieces[doc_id]:
            first.setdefault(p, doc_id)
    out = {}
    for doc_id, mine in pieces.items():
        seen, flags = set(), []
        for p in mine:
            flags.append(first[p] != doc_id or p in seen)
            seen.add(p)
        kept, sources, k = b"", set(), 0
        while k < len(mine):
            n = k
            while n < len(mine) and flags[n] == flags[k]:
                n += 1
            if flags[k] and sum(map(len, mine[k:n])) >= chunks.PASSAGE:
                sources |= {first[p] for p in mine[k:n]} - {doc_id}
            else:
                kept += b"".join(mine[k:n])
            k = n
        out[doc_id] = kept.decode(), sorted(sources)
    return out


def test_cuts_follow_the_rule():
    for text in (prose(400, 1), "é日😀" * 300, prose(30, 2) + "x" * 900 + prose(30, 3), "a", "a b " * 200):
        assert ends(text) == brute_ends(text.encode())


def test_insertions_move_near_cuts_only():
    text = prose(500, 4)
    at = 1500
    moved = text[:at] + "a new start " + text[at:]
    a, b = set(ends(text)), {e - 12 for e in ends(moved)}
    assert {e for e in a if e > at + 100} == {e for e in b if e > at + 100}
    assert {e for e in a if e < at} == {e + 12 for e in b if e + 12 < at}


def test_texts_of_a_step_do_not_touch_each_other():
    texts = [prose(40, i).encode() for i in range(20)]
    bounds = np.cumsum([0, *map(len, texts)])
    together = chunks.cuts(np.frombuffer(b"".join(texts), np.uint8), bounds)
    alone = [b + e for t, b in zip(texts, bounds) for e in ends(t.decode())]
    assert list(together) == alone


def test_passages_by_comparing_all_chunks(spark):
    passage = prose(80, 77)
    rows = [(i, prose(100 + i, i)) for i in range(30)]
    rows += [(100 + i, prose(40 + i, 200 + i) + " " + passage + "\n" + prose(30, 300 + i)) for i in range(25)]
    rows += [(200, prose(100, 3)), (201, f"{passage} {passage} {passage}"), (202, prose(20, 888)), (203, None), (204, ""), (205, "line of text here\n" * 60)]
    found = chunks.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        text, sources = expected[r["doc_id"]]
        assert (r["text"] or "", r["repeats_of"]) == (text, sources)
        assert r["n_removed"] == r["n_bytes"] - len(text.encode())
        if 100 < r["doc_id"] < 200:  # all later copies lose most of the passage, nothing else
            assert 0.7 * len(passage) < r["n_removed"] <= len(passage) + 2
        if r["doc_id"] <= 100 or r["doc_id"] in (202, 203, 204):
            assert r["n_removed"] == 0
    assert [r["text"] for r in found if r["doc_id"] == 203] == [None]


def test_odd_rows(odd_documents, no_documents):
    found = chunks.remove_passages(odd_documents)
    assert found.columns == [*odd_documents.columns, *chunks.ADDED]
    rows = found.collect()
    assert len(rows) == 20
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_removed"] == 0 and by[2][0]["text"] == "" and by[2][0]["repeats_of"] == [1]
    assert all(r["text"] == "" for r in by[15]) and by[10][0]["text"] == "" and by[9][0]["n_removed"] == 0
    assert sorted((r["text"] is None, r["n_removed"] > 0) for r in by[None]) == [(False, True), (True, False)]
    assert by[4][0]["text"] is None and by[5][0]["text"] == "" and by[7][0]["text"] == "one"
    assert chunks.remove_passages(no_documents).count() == 0


def test_rows_without_id_whose_short_hashes_are_equal(spark):
    """Two of 300,000 texts share 32 bits of hash; what they have in common goes from one of them alone, nothing else does."""
    shared = prose(60, 7)
    texts = spark.range(300_000).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(" "), F.repeat(F.lit("tail of it "), (F.col("id") % 40).cast("int")), F.lit(shared)).alias("text"))
    pairs = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1 AND length(t[0]) <> length(t[1])").limit(3).collect()
    assert pairs
    for row in pairs:
        first, second = row["t"][:2]
        documents = spark.createDataFrame([(None, first), (None, second), (1, "lead " + shared)], "doc_id long, text string")
        found = chunks.remove_passages(documents).collect()
        lost = [r["n_removed"] for r in found if r["doc_id"] is None]
        assert len(lost) == 2 and all(len(shared) * 0.6 < n <= len(first) + len(second) for n in lost)
        assert all(r["text"][:30] in (first[:30], second[:30]) for r in found if r["doc_id"] is None)


def test_passages_without_spaces_at_other_offsets(spark):
    rng = np.random.default_rng(9)

    def script(n):
        return "".join(map(chr, rng.integers(0x4E00, 0x9FA5, n)))

    rows, passages = [], []
    for k in range(60):
        passages.append(script(300))
        rows += [(2 * k, script(int(rng.integers(0, 400))) + passages[k] + script(200)),
                 (2 * k + 1, script(int(rng.integers(0, 400))) + passages[k] + script(int(rng.integers(0, 300))))]
    out = {r["doc_id"]: r for r in chunks.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = [out[2 * k + 1]["n_removed"] for k in range(60)]
    assert min(removed) > 0 and np.mean(removed) > 0.8 * 900 and max(removed) <= 900
    for k in range(60):
        assert out[2 * k]["n_removed"] == 0 and out[2 * k]["text"] == rows[2 * k][1]
        assert out[2 * k + 1]["repeats_of"] == [2 * k]
        assert len(out[2 * k + 1]["text"].encode()) == len(rows[2 * k + 1][1].encode()) - removed[k]


def unbroken_ends(text):
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, len(data)])
    return list(chunks.cuts(data, bounds, chunks.inside_words(data, bounds)))


def test_insertions_in_unbroken_text_move_near_cuts_only():
    rng = np.random.default_rng(10)
    text = "".join(map(chr, rng.integers(97, 123, 6000)))
    before, after = unbroken_ends(text), unbroken_ends(text[:1500] + "qqq" + text[1500:])
    assert [e for e in before if e > 1700] == [e - 3 for e in after if e > 1703]
    assert [e for e in before if e < 1400] == [e for e in after if e < 1400]
    assert 30 < len(text) / len(before) < 70 and max(np.diff(before)) <= chunks.MOST
    spaced = prose(400, 1)
    assert unbroken_ends(spaced) == ends(spaced)


def test_places_inside_words_by_the_rule():
    rng = np.random.default_rng(11)
    long_ = ["".join(map(chr, rng.choice([97, 122, 233, 0x4E00, 0x1F600], 90))), "x" * 200, "ab" * 100, "short"]
    text = " ".join([*long_, prose(5, 1), "".join(map(chr, rng.integers(97, 123, 300)))])
    data, want, at = text.encode(), [], 0
    for word in text.split(" "):
        size = len(word.encode())
        if size >= chunks.UNBROKEN:
            value = {}
            for p in range(at + chunks.GEAR_BITS, at + size):
                if data[p] & 0xC0 != 0x80:
                    h = 0
                    for b in data[p - 16:p]:
                        h = (2 * h + int(chunks._GEAR[b])) % 65536
                    value[p] = h
            want += [p for p, h in value.items() if all(h < value.get(q, 65536) for q in range(p - chunks.NEAR, p + chunks.NEAR + 1) if q != p)]
        at += size + 1
    array = np.frombuffer(data, np.uint8)
    assert list(chunks.inside_words(array, np.array([0, len(array)]))) == want and want
