"""Cases at the edges: shared and missing ids, clashing columns, limits that are crossed, ledgers that are opened again."""

import multiprocessing
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, decontaminate, jaccard, language, media, packing, quality, secrets, suffixes, tokens, toxicity, webp

from ..conftest import SMALL
from .conftest import sentence
from .test_exact import SECRETS, brute_components, brute_removed, sets_of

A, B = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_sets_of_a_shared_doc_id_are_one_document(spark):
    rows = [(1, A), (1, B), (2, B + " x"), (3, A + " y"), (4, "other words that nobody has here"), (None, A + " z"), (None, "only this one has no id and no partner"), (None, None), (5, None)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("1", 10, "1"), ("1", 10, "1"), ("2", 11, "1"), ("3", 11, "1"), ("4", 2, "4"), ("None", 11, "1"), ("None", 5, "None"), ("None", 0, "None"), ("5", 0, "5")])


def test_one_of_each_of_rows_without_ids(spark):
    rows = [(None, A), (None, A + " y"), (None, A), (7, B), (None, B + " x"), (9, B + " q"), (None, ""), (None, None), (8, None), (7, "some text that differs")]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(kept) == 6 and {(7, B), (None, ""), (None, None), (8, None), (7, "some text that differs")} < kept
    assert len(kept & {(None, A), (None, A + " y")}) == 1


@pytest.mark.parametrize("every", [1, 3])
def test_hot_anchors_are_split(spark, every):
    rng = random.Random(5)
    phrase, parts = " and all of this is said again and again ", [sentence(rng, 8) for _ in range(12)]
    rows = [(i, phrase.join(rng.choice(parts) for _ in range(4))) for i in range(80)] + [(80, None), (81, phrase * 30), (None, phrase * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bits = suffixes._shared_bits(suffixes.make_blocks(docs, 1500), 6, 40, every).persist()
    hot = suffixes.hot_anchors(bits)
    assert len(hot) and list(hot) == sorted(set(hot.tolist()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed(docs, 1500, 40, every).collect()]
    last = 1 << 40
    want = brute_removed([(last if i is None else i, t) for i, t in rows])
    assert sorted((last if g[0] is None else g[0], *g[1:]) for g in got) == want
    plain = [(r.doc_id, r.n_removed) for r in suffixes.removed(docs, 1500, 1 << 30, every).collect()]
    assert sorted(map(str, plain)) == sorted(str(g[:1] + g[2:3]) for g in got)


def test_salted_columns(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        t = base[:]
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join([*base[:30], *(f"u{rng.randrange(10**6)}" for _ in range(20))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "PART", 7)
    monkeypatch.setattr(jaccard, "HEAVY_MIN", 1)
    assert {r.doc_id: r.component_id for r in jaccard.components(df).collect()} == brute_components(sets_of(rows))


def test_encoder_with_small_caches(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "WORDS", 60)
    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(tokens, "SLICE", 300)
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    rng = random.Random(4)
    parts = ["isn't", "they're!", "'s", "x's,", "abc.", "ABC$$$", "42%", "a1b2", "naïve;", "école…", "-dash-", "(q)", "'", "...", "wörd", "I'll.", "don't?!", "_x_", "é", "12", "end\n", "\nnext,", "\nWord's", "tab\there"]
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(30):
        texts = [" ".join(rng.choice(parts) + rng.choice(["", "", "q", ".", "Z,"]) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        want = [np.array([*t.encode(x, add_special_tokens=False).ids, 9], "<u4").tobytes() for x in texts]
        assert enc.encode(texts, 9) == want
        if rng.random() < 0.3:
            enc.rest()


def test_long_documents_are_cut_once():
    ids = np.arange(3_000_001, dtype="<u4").tobytes()
    p = packing.Packer()
    p.add(1, 5, 3_000_001, ids)
    full = p.take()
    assert len(full) == 3_000_001 // 2048 and b"".join(x[0][3] for x in full) + p.windows[0][1][0][3] == ids
    assert [x[0][1] for x in full[:3]] == [5, 5 + 2048, 5 + 4096] and p.windows[0][1][0][1] == 5 + 2048 * len(full)


def _scan_elsewhere(path, rows, out):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.checkpoint.dir", path + "-shared").getOrCreate()
    out.put(secrets.Ledger(s, path).update(s.createDataFrame(rows, "doc_id long, text string")))
    s.stop()


def test_ledger_lasts(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = [(1, SECRETS[0][1]), (2, SECRETS[1][1]), (3, None)]
    later = [(1, SECRETS[0][1]), (2, "nothing now"), (3, SECRETS[2][1]), (4, SECRETS[1][1])]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets.Ledger(spark, path).update(frame(first), path="doc_id", history="old") == 3
    again = secrets.Ledger(spark, path)  # knows what the other has scanned
    assert again.update(frame(first), path="doc_id", history="old") == 0
    assert again.update(frame(later), path="doc_id", history="new") == 2
    seen = {(r.path, r.version) for r in again.versions().collect()}
    assert seen == {(str(i), "old") for i in (1, 2, 3)} | {(str(i), "new") for i in (1, 2, 3, 4)} and again.versions().count() == 7
    found = {(r.path, r.version) for r in again.occurrences().collect()}
    assert found == {("1", "old"), ("1", "new"), ("2", "old"), ("3", "new"), ("4", "new")}
    # two writers at once: both commit, and what both scanned counts once
    a, b = secrets.Ledger(spark, path), secrets.Ledger(spark, path)
    new = frame([(5, "token=abcdefgh1")])
    unseen = secrets._scan_blobs(secrets.addressed(new), secrets.RULE_VERSION)
    a._commit(unseen, "scans"), b._commit(unseen, "scans")
    rows = secrets.addressed(frame([(5, "token=abcdefgh1"), (6, "token=abcdefgh1")]))
    assert [len(r.spans) for r in secrets.Ledger(spark, path).findings(rows).collect()] == [1, 1]
    # another process
    context = multiprocessing.get_context("spawn")
    out = context.Queue()
    p = context.Process(target=_scan_elsewhere, args=(path, [*first, *later, (9, "one more")], out))
    p.start()
    assert out.get(timeout=120) == 1
    p.join()


def test_masks_with_clashing_columns(spark):
    rows = [(i, t, [i], "b", "s", 3) for i, t in SECRETS] + [(7, "x" * 200_000 + " token=abcdefghij", [7], None, "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>, blob string, path string, version int")
    got = {r.doc_id: r for r in secrets.redact(df, secrets.Ledger(spark, common.fresh_path(spark, "ledger"))).collect()}
    assert len(got) == len(rows) and all(not secrets.scan(r.text or "") and r.spans == [i] for i, r in got.items()) and got[1].blob == "b"
    assert got[7].text == "x" * 200_000 + " [REDACTED]"


def test_benchmark_with_clashing_columns_and_missing_ids(spark):
    item = " ".join(f"word{k}" for k in range(15))
    rows = [(1, f"Before, {item}! {' '.join('x' * 40)}", [1], "i", 9), (1, f"Before, {item}! {' '.join('x' * 40)}", [1], "i", 9), (None, "clean", [2], "i", 9), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, items string, n_words int")
    bench = spark.createDataFrame([(None, item), ("a", "word3 word4"), (None, "")], "item_id string, text string")
    got = decontaminate.remove(df, bench).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", f"Before, ! {' '.join('x' * 40)}")] * 2 + [("None", "clean"), ("2", None)]) and got[0].n_words in (9, None)
    for limit in (3, decontaminate.BLOCK_WORDS):
        one = decontaminate.find(df, bench, limit=limit).filter("doc_id = 1").first()
        assert one.runs == [1, 16] and one["items"] == ["a"]
    none = decontaminate.find(df, bench.filter("item_id is null")).filter("doc_id = 1").first()
    assert none.runs == [1, 16] and none["items"] == []


def test_shapes_of_long_words():
    a, b = "a" * 70 + "1", "a" * 70 + "B"
    assert quality._shape(a) != quality._shape(b) and quality._shape(a) == "x9"


def test_vectors_do_not_depend_on_the_tree(spark, docs, monkeypatch):
    many = docs.repartition(9, "doc_id")
    flat = quality.word_vectors(many)
    monkeypatch.setattr(quality, "FAN", 2)
    assert np.allclose(quality.word_vectors(many), flat, atol=1e-5) and np.abs(flat).sum() > 0


def test_scores_of_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 20) + (" vermin" if i % 3 == 0 else "") + (" $$$" * 3 if i % 4 == 0 else ""), "en" if i % 2 else "de", "s", 0.5, True, 1, "und") for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4]], "doc_id long, text string, lang string, source string, score double, held_out boolean, predicted int, lang_pred string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    for got in (quality.score(docs, quality.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels)), language.predict(docs, language.train(docs))):
        rows_of = [r for r in got.collect() if r.doc_id == 4]
        assert got.count() == 122 and len(rows_of) == 3 and len(set(rows_of)) == 1
    model = quality.train(docs, labels)
    assert quality.select_good(docs, model).columns == docs.columns


@pytest.mark.parametrize(("name", "truth", "least"), [("op1_quality", "quality", 0.9), ("op5_toxicity", "toxic", 0.85)])
def test_held_out_accuracy_on_the_tables(spark, name, truth, least):
    from millrace.llm import queries

    sf = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", truth)
    got = queries.QUERIES[name](spark, sf).filter("held_out").join(labels, "doc_id").filter(F.col(truth).isNotNull()).collect()
    assert len(got) > 50 and np.mean([r.predicted == r[truth] for r in got]) > least


def test_held_out_languages_on_the_tables(spark):
    from millrace.llm import queries

    sf = SMALL.replace("0.001", "0.01")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op4_language"](spark, sf).filter("held_out and lang_pred <> 'und'").join(lang, "doc_id").filter("lang is not null").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_queries_files_use_the_whole_format(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = ["0123456789" * 7, "".join(rng.choice("ab ") for _ in range(64 * 40)), "the same line again and again, with words\n" * 60, sentence(rng, 300), "a" * 700, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = media.encode(df)
    used = {}
    for name in ("_undo_predictor", "_undo_palette", "_literals"):
        plain = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, plain=plain, name=name, **k: used.update({name: 1 + used.get(name, 0)}) or plain(*a, **k))
    widths = set()
    for r in stored.collect():
        assert webp.decode_samples(r.media).tobytes().rstrip(b"\0") == texts[r.doc_id].encode()
        widths |= {webp.decode_vp8l(x)[0] for x in webp.images(r.media)}
    assert set(used) == {"_undo_predictor", "_undo_palette", "_literals"} and widths == {16, 64}  # 16: back-references and the colour cache
    pixels = media.write_pixels(stored, f"file://{tmp_path}/pixels")
    assert {r.doc_id: bytes(r.pixels).rstrip(b"\0").decode() for r in pixels.collect()} == dict(enumerate(texts))


def test_referring_images_have_both_kinds_of_symbols():
    rng = random.Random(5)
    text = "".join(rng.choice(["abcd", "efgh", "ijkl", "mnop", "qrst"]) for _ in range(40)) * 30
    part = media.payload(text)
    raw = webp.images(webp.encode_samples(part))[0]
    bits = webp.Bits(raw)
    assert bits.read(8) == 0x2F and bits.read(14) == 15
    bits.read(14 + 1 + 3)
    assert (bits.read(1), bits.read(1), bits.read(4)) == (0, 1, webp.CACHE_BITS)
    bits.read(1)
    green = webp._read_code(bits, 280 + (1 << webp.CACHE_BITS))
    used = set(green.symbol.tolist())
    assert any(256 <= s < 280 for s in used) and any(s >= 280 for s in used)


@pytest.mark.parametrize("mode", [1, 2])
def test_uniform_predictors_by_sums(mode):
    rng = np.random.default_rng(mode)
    width, height = 24, 9
    p = rng.integers(0, 1 << 32, width * height, dtype=np.uint32)
    fast = webp._undo_predictor(p, width, 9, [[mode]])
    slow = webp._undo_predictor(p, width, 2, [[mode] * 6] * 2 + [[mode] * 5 + [0]])  # a block beyond the others, so the modes differ
    assert fast[: width * 8].tolist() == slow[: width * 8].tolist()


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(20, 80)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t), "x", [1], 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (100, "", "en", "s", 0, "x", None, None), (101, texts[7] + " more", "en", "s", 9, "x", [2], 1.0), (102, "long " * 50_000, "en", "s", 9, "x", [2], 1.0), (103, "my token=abcdefgh12 here " + texts[9][::-1], "en", "s", 1, "x", [2], 1.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, spans array<int>, score double"
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 1, 0), (102, 1, 0), (103, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[11].split()[:12]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in got}
    assert {100, 102, 103, None} <= ids and 101 not in ids and {i for i in range(60) if i != 7} <= ids
    assert sum(r.length for r in got if r.doc_id == 3) == next(r.doc_tokens for r in got if r.doc_id == 3)
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_jaccard_drops_what_it_has_read(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 4}x{k}" for k in range(60)) + f" end{i}") for i in range(40)]
    df, made, left = spark.createDataFrame(rows, "doc_id long, text string"), [], []
    init, cc = common.Scratch.__init__, jaccard.connected_components
    monkeypatch.setattr(common.Scratch, "__init__", lambda self, *a: (made.append(self), init(self, *a))[1])

    def spied(*a):
        left.append([t.columns for _, t in made[0].paths.values()])
        return cc(*a)

    monkeypatch.setattr(jaccard, "connected_components", spied)
    got = {r.doc_id: r.component_id for r in jaccard.components(df).collect()}
    assert got == {i: i // 4 * 4 for i in range(40)}
    assert made[0].clean  # shuffle files go with the query that made them
    assert all("prefix" not in t and "salt" not in t or "onward" in t for tables in left for t in tables)  # signatures and unmatched entries
    assert sorted(left[-1]) == sorted([["__row", "doc_id", "n", "digest"], ["digest", "rep", "n", "last_count", "last_hash", "node"], ["x", "y"]])
