"""Licences, benchmark items, archives, packing and the pipeline: round trips and brute force."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from impactloom.llm import decontaminate, licenses, packing, warc
from impactloom.llm.common import shared_path
from impactloom.llm.queries import tokenizer_path

from .messy import LONG, PROSE, documents, labels, pages
from .test_dedup import brute_components, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def test_licences(spark):
    mit = f"{licenses.SENTENCES['mit-grant']}:\n\n{licenses.SENTENCES['mit-notice']}. {licenses.SENTENCES['as-is'].upper()}."
    docs = [(1, mit), (2, "Released under the MIT Licence."), (3, "a mit license once"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["n_sentences"] == 3
    assert got[2]["licenses"] == "MIT" and got[3]["licenses"] == "" and got[4]["n_sentences"] == 0
    assert licenses.scan(documents(spark)).count() == 12 and licenses.scan(documents(spark, [])).collect() == []


def test_notices_are_found_across_line_ends(spark):
    known = {name: s for name, s in licenses.SENTENCES.items() if not any(a in s for a in licenses.ANCHORS)}
    for name, sentence in known.items():
        for gap in (" ", "\n", "\n# "):
            text = gap.join(licenses.plain(sentence).split(" "))
            found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
            assert found["n_sentences"] == 1, (name, text)
    assert known


def brute_contained(docs, items, k=5, percent=80):
    sets, wanted = defaultdict(set), defaultdict(set)
    for d, t in docs:
        sets[d] |= shingles(t, k)
    for i, t in items:
        wanted[i] |= shingles(t, k)
    return {(d, i, len(s & w), len(w)) for d, s in sets.items() for i, w in wanted.items() if w and 100 * len(s & w) >= percent * len(w)}


def test_benchmark_items_equal_brute_force(spark):
    words = LONG.split()
    long = " ".join([*words[:20_000], *PROSE.split(), *words[20_000:]])
    item = PROSE.split()
    docs = [(1, PROSE), (2, long), (3, " ".join(item[:12])), (4, None), (5, ""), (6, "one two three"), (7, "x " + " ".join(item[:10]) + " CHANGED " + " ".join(item[11:])), (8, " ".join(words[100:160])), (8, "again")]
    items = [(1, PROSE), (2, "one two three"), (3, None), (4, " ".join(words[100:140])), (4, " ".join(words[140:160]))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(df, it).collect()}
    assert got == brute_contained(docs, items)
    assert {(d, i) for d, i, _, _ in got} >= {(1, 1), (2, 1), (6, 2), (8, 4)}
    assert decontaminate.contaminated(documents(spark), it.where("item_id = 3")).collect() == []
    assert decontaminate.contaminated(documents(spark, []), it).collect() == []
    found = {r["doc_id"] for r in decontaminate.contaminated(documents(spark), it).collect()}
    assert {1, 2, 3, 9, None} <= found


@pytest.mark.parametrize(("template", "own"), [(15, 20), (40, 6), (40, 14), (9, 60)])
def test_items_of_one_template_are_no_pairs_of_all(spark, monkeypatch, template, own):
    """Documents that quote a template, some with the rest of one item: candidates grow with the documents, not with both."""
    rng = random.Random(template)
    head = [f"t{i}" for i in range(template)]
    n = 120
    items = [(i, " ".join(head + [f"w{rng.randrange(10**6)}" for _ in range(own)])) for i in range(n)]
    docs = [(i, f"a b c {' '.join(head)} " + (items[i][1].split(" ", template)[template] if i % 2 else " ".join(f"v{rng.randrange(10**6)}" for _ in range(30)))) for i in range(n)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen, cut = [], decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda x: seen.append(r := cut(x)) or r)
    got = {tuple(r) for r in decontaminate.contaminated(df, it).collect()}
    assert got == brute_contained(docs, items)
    pairs = [x.count() for x in seen if x.columns == ["doc", "item"]]
    assert len(pairs) == 1 and pairs[0] <= max(len(got), 4 * n)


def test_edited_items_are_found_wherever_the_edits_stand(spark):
    """Items of all sizes at 80 % and a little more: words replaced in the middle, evenly, or cut off at the ends."""
    r, docs, items = random.Random(4), [], []
    for n, i in enumerate([*range(1, 60), *range(60, 200, 3)]):
        words = [f"a{i}b{j}" for j in range(i)]
        items.append((n, " ".join(words)))
        lost = max(i - 4, 1) // 5
        for edits in {lost // 5, max(lost // 5 - 1, 0)}:
            for at in ([i * (e + 1) // (edits + 1) for e in range(edits)], [i // 2 + e for e in range(edits)], r.sample(range(i), edits)):
                own = [w if j not in at else "changed" for j, w in enumerate(words)]
                docs.append((len(docs), " ".join(["before", *own, "after"])))
        docs.append((len(docs), " ".join(words[lost // 2 : i - (lost - lost // 2)])))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert len(want) > 250 and {tuple(x) for x in decontaminate.contaminated(df, it).collect()} == want


def test_clean_rows_are_told_apart_by_identifier_and_text(spark):
    rows = [(1, PROSE + " x"), (None, "y " + PROSE), (None, "free of it"), (1, "free too"), (1, PROSE + " x"), (2, None), (2, "")]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    clean = decontaminate.clean_rows(df, spark.createDataFrame([(1, PROSE)], "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean.collect()) == [("1", "free too"), ("2", ""), ("2", ""), ("None", "free of it")]


def test_archive_round_trip(spark):
    rows = [(1, "http://a\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (7, "z", "q" * 100_000)]
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages(spark, rows), path)
    archive = warc.read_archive(spark, path)
    read = archive.collect()
    assert len(read) == len(rows)
    ids = [re.search("WARC-Record-ID: (.*)\r\n", r["header"])[1] for r in read]
    assert len(set(ids)) == len(rows) and all(re.fullmatch("<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", i) for i in ids)
    for r in read:
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head + b"\r\n\r\n" == r["header"].encode() and block.endswith(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        http, body = block[:-4].split(b"\r\n\r\n", 1)
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and int(fields["Content-Length"]) == len(http) + 4 + len(body)
        assert body == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"") and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        assert fields["WARC-Type"] == "response" or fields["WARC-Refers-To"] in ids
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest_of(archive).collect())
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want.append((str(page), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    assert got == sorted(want)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    empty = shared_path(spark, "warc-test")
    warc.write_archive(pages(spark, []), empty)
    assert warc.digest_of(warc.read_archive(spark, empty)).collect() == []


def test_archive_with_a_damaged_payload_is_not_read(spark):
    path = shared_path(spark, "warc-test")
    warc.write_archive(pages(spark, [(1, "u", "x")]), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-2/records")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, f"{path}-2").collect()


def assert_packed(pieces, texts, tokenizer, size=4096):
    """Each id lies in exactly one piece, sequences have no gaps, few are not full."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            own = ids[p["start"] : p["start"] + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids) and len(own) == p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += p["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    total = sum(p["length"] for p in pieces)
    assert len(by_seq) * size <= total * 1.02 + 2 * size


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(spark)
    t = Tokenizer.from_file(path)
    texts = {i: f"{PROSE} {i} " * (1 + i * i % 37) + "ÄÖ İx ﬁ, \t .x" for i in range(120)} | {900: LONG, 901: None, 902: "", 903: "  \n ", 904: "x" * 3_000, 905: "a" * 4_095}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert_packed(packing.pack(df, path).collect(), texts, t)
    assert packing.pack(documents(spark), path).select("doc_id").distinct().count() == 10
    assert packing.pack(documents(spark, []), path).collect() == []


def test_pipeline_stages_of_messy_rows(spark, tmp_path):
    """Null and repeated identifiers, empty and long texts, empty tables and clashing columns, in every stage."""
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PROSE), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda rows: sorted((str(r["doc_id"]), r["text"] or "") for r in rows)
    full, empty = documents(spark), documents(spark, [])
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
        df = stage(spark, full, str(tmp_path))
        out[name] = df.collect()
        assert name == "packing" or df.columns == full.columns
    every = text(full.collect())
    assert set(text(out["quality classifier"])) <= set(every)
    assert text(out["exact dedup"]) == sorted([("1", PROSE), ("3", PROSE + " today"), ("4", ""), ("6", LONG), ("7", " \t\n "), ("8", "Ünïcödé ÄÖ bob@x.org 😀")])
    assert text(out["MinHash near-dedup"]) == sorted([("1", PROSE), ("4", ""), ("5", ""), ("6", LONG), ("7", " \t\n "), ("8", "Ünïcödé ÄÖ bob@x.org 😀"), ("None", "")])
    assert text(out["benchmark decontamination"]) == [x for x in every if PROSE not in x[1].lower()]
    assert {str(r["doc_id"]) for r in out["packing"]} == {d for d, _ in every}
    assert spark.conf.get(corpus_pipeline.BATCH) == corpus_pipeline.ROWS_A_BATCH
    spark.conf.set(corpus_pipeline.BATCH, "10000")


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input: exact and near copies, benchmark passages, packing; the classifier keeps what it predicts good."""
    from tokenizers import Tokenizer

    from impactloom.llm import quality
    from impactloom.llm.common import table

    docs, tables = table(spark, SMALL, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns
        tables[name] = (docs, rows := out.collect())
        docs = spark.createDataFrame(rows, out.schema)
    before, kept = tables["quality classifier"]
    good = {r["doc_id"] for r in quality.score(before, table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept} == good
    before, kept = tables["exact dedup"]
    first = {}
    for r in sorted(before.collect(), key=lambda r: -r["doc_id"]):
        first["".join(c.lower() if c.isascii() else c for c in r["text"])] = r["doc_id"]
    assert {r["doc_id"] for r in kept} == set(first.values())
    before, kept = tables["MinHash near-dedup"]
    want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in kept} == {d for d, (_, c) in want.items() if c == d}
    before, kept = tables["benchmark decontamination"]
    found = brute_contained([(r["doc_id"], r["text"]) for r in before.collect()], [tuple(r) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()])
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before.collect()} - {d for d, *_ in found}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert_packed(pieces, {r["doc_id"]: r["text"] for r in docs.collect()}, Tokenizer.from_file(tokenizer_path(spark)))
    spark.conf.set(corpus_pipeline.BATCH, "10000")
    whole = corpus_pipeline.run(spark, SMALL)
    assert spark.conf.get(corpus_pipeline.BATCH) == "10000"
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_unknown_tokenizers_are_refused(spark, tmp_path):
    import json

    path = tokenizer_path(spark)
    packing.check_tokenizer(path)
    told = json.load(open(path, encoding="utf-8"))
    for change in ({"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}, {"post_processor": {"type": "ByteLevel"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(told | change), encoding="utf-8")
        with pytest.raises(ValueError, match="packing needs"):
            packing.check_tokenizer(str(other))
