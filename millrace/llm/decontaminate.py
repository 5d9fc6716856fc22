"""Benchmark decontamination by a generalised suffix automaton of the normalised items.

Words are runs of letters, digits and non-ASCII characters of the text with
A-Z lower-cased.  All items of a block go into one automaton over word ids; a
document's words are streamed through it, and at each word the length of the
longest suffix that occurs in an item is known.  A length of ``window`` words
or more means that a window of the state's items ends here; items shorter than
a window count when they occur whole.  Words that no item has reset the
automaton at once.

The benchmark's items are dealt to blocks of about ``BLOCK_WORDS`` words.  Tasks
build a block's automaton and write it, as a few flat arrays, to the shared
folder, so the benchmark does not pass through the driver.  A worker holds one
automaton at a time, whose size the block bounds: with one block it stays, with
several each batch of documents is passed over them one after the other.  An
item longer than a block has a block of its own size.

Null texts have no words.  Items without words never occur; items with the
same text are separate items; repeated rows of an item count once; an item
without an item_id makes hits, as its words do occur, but is not listed or
counted.  Repeated documents get equal rows.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import re
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, BLOCK_WORDS = 10, 500_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def lower(text: str) -> str:
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text)) if text else []


class Automaton:
    """Suffix automaton of several word sequences, as it is built; ``Matcher`` is what is kept of it."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        paths = []
        for name, ws in items:
            last, path = 0, []
            for w in ws:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
            paths.append((name, [self.vocab[w] for w in ws]))
        #: state -> items that have the state's window, by the state whose strings include windows
        self.items: dict[int, set[str]] = {}
        #: state -> {length: items that are whole and shorter than a window}
        self.whole: dict[int, dict[int, set[str]]] = {}
        for name, ids in paths:
            s = 0
            for k, c in enumerate(ids):
                s = self.next[s][c]
                t = s
                while self.len[self.link[t]] >= window:
                    t = self.link[t]
                if self.len[t] >= window:
                    self.items.setdefault(t, set()).add(name)
            if 0 < len(ids) < window:
                self.whole.setdefault(s, {}).setdefault(len(ids), set()).add(name)
        #: state -> the state with its windows; and its next state up the links with a whole item
        self.at, self.short = {}, {}
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            if self.len[s] >= window:
                self.at[s] = s if self.len[self.link[s]] < window else self.at[self.link[s]]
            up = self.link[s]
            if s in self.whole or up in self.short:
                self.short[s] = s if s in self.whole else self.short[up]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


class Matcher:
    """An automaton in flat arrays: 28 bytes a state, and an entry for each transition of a state that has several."""

    def __init__(self, a: Automaton) -> None:
        self.window, self.vocab, size = a.window, a.vocab, len(a.vocab)
        self.items, self.whole, self.v = a.items, a.whole, size
        self.root = array("i", [0]) * size
        for c, t in a.next[0].items():
            self.root[c] = t
        # a state's only word and next state, or -2 and entries of ``more``
        self.word, self.then, self.more = array("i", [-1]) * len(a.next), array("i", [0]) * len(a.next), {}
        for s, step in enumerate(a.next):
            if len(step) == 1:
                ((self.word[s], self.then[s]),) = step.items()
            elif s and step:
                self.word[s] = -2
                self.more.update({s * size + c: t for c, t in step.items()})
        self.link, self.len = array("i", a.link), array("i", a.len)
        self.at = array("i", (a.at.get(s, 0) for s in range(len(a.next))))
        self.short = array("i", (a.short.get(s, 0) for s in range(len(a.next))))

    def hits(self, ws: list[str]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit runs of words (begin, end) in order, overlapping ones joined, and the items that occur."""
        root, word, then, more, v = self.root, self.word, self.then, self.more, self.v
        link, length, at, short, window = self.link, self.len, self.at, self.short, self.window
        runs: list[list[int]] = []
        found: set[str | None] = set()
        s = n = 0
        for i, c in enumerate(map(self.vocab.get, ws)):
            if c is None:
                s = n = 0
                continue
            if s:
                w = word[s]
                t = then[s] if w == c else more.get(s * v + c) if w == -2 else None
                if t is None:
                    s = link[s]
                    while s:
                        w = word[s]
                        t = then[s] if w == c else more.get(s * v + c) if w == -2 else None
                        if t is not None:
                            break
                        s = link[s]
                    n = length[s]
                    if not s:
                        t = root[c]
                s, n = t, n + 1
            else:
                s, n = root[c], 1
            reach = 0
            if n >= window:
                reach = window
                found |= self.items[at[s]]
            if short[s] or short[link[s]]:
                u = short[s]
                while u:
                    for k, names in self.whole[u].items():
                        if k <= n:
                            reach = max(reach, k)
                            found |= names
                    u = short[link[u]]
            if reach:
                lo = i + 1 - reach
                while runs and runs[-1][1] >= lo:
                    lo = min(lo, runs.pop()[0])
                runs.append([lo, i + 1])
        return [(a, b) for a, b in runs], found


def build(benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_WORDS) -> tuple[str, list[str]]:
    """The folder and the names of the files of all blocks' matchers."""
    spark = benchmark.sparkSession
    folder = common.fresh_path(spark, "matchers")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()

    def count(batches):
        for batch in batches:
            sizes = [len(words(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([sum(sizes)], pa.int64())], ["n"])

    total = common.map_arrow(items.select("text"), count, "n long").agg(F.sum("n")).first()[0] or 0
    blocks = -(-2 * total // limit) if total > limit else 1

    def write(batches):
        from pyarrow import fs

        held: dict[int, list] = {}
        for batch in batches:
            for b, name, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item_id", "text"))):
                if ws := words(text):
                    held.setdefault(b, []).append((name, ws))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in sorted(held):
            automaton = Automaton(sorted(held.pop(b), key=lambda x: (x[0] is None, x[0] or "", x[1])), window)
            raw = pickle.dumps(Matcher(automaton))
            del automaton
            name, temporary = f"block-{b:06d}", f"{base}/_{b}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(raw)
            store.move(temporary, f"{base}/{name}")
            yield pa.record_batch([pa.array([name], pa.string())], ["name"])

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return folder, sorted(r.name for r in common.map_arrow(dealt.select("block", "item_id", "text"), write, "name string").collect())  # a name a block


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), limit: int = BLOCK_WORDS, prefix: str = "") -> DataFrame:
    """Every document with ``keep`` columns, n_words, runs (flat begin, end pairs of words) and items (sorted ids); ``prefix`` goes before the three new names."""
    folder, blocks = build(benchmark, window, limit)
    cols = list(dict.fromkeys(["doc_id", *keep, "text"]))
    out = [c for c in cols if c in keep or c == "doc_id"]

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)

        def load(name: str) -> Matcher:
            with store.open_input_stream(f"{base}/{name}") as f:
                return pickle.loads(f.read())

        only = load(blocks[0]) if len(blocks) == 1 else None
        for batch in batches:
            split = [words(text) for text in batch.column("text").to_pylist()]
            got: list[list] = [[] for _ in split]
            names: list[set] = [set() for _ in split]
            for name in blocks:
                m = only or load(name)
                for k, ws in enumerate(split):
                    r, f = m.hits(ws)
                    if r:
                        got[k] += r
                        names[k] |= f
                del m
            runs = [[x for r in (merged(g) if len(blocks) > 1 else g) for x in r] for g in got]
            items = [sorted(x for x in f if x is not None) for f in names]
            new = [pa.array([len(ws) for ws in split], pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*[batch.column(c) for c in out], *new], [*out, *(f"{prefix}{c}" for c in ("n_words", "runs", "items"))])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in out)
    return common.map_arrow(docs.select(*cols), run, f"{schema}, `{prefix}n_words` bigint, `{prefix}runs` array<bigint>, `{prefix}items` array<string>")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The documents without their hit passages; those with more than ``coverage`` of their words hit go altogether.

    A passage runs from its first hit word to the end of its last; n_chars, if
    there is one, follows the text.  Other columns may have any names.
    """
    found = find(docs, benchmark, window, tuple(docs.columns), prefix="__")
    cut = F.size("__runs")
    hit = F.expr("aggregate(transform(sequence(1, size(__runs), 2), i -> __runs[i] - __runs[i - 1]), 0L, (a, x) -> a + x)")
    kept = found.filter((cut <= 0) | (hit <= F.lit(coverage) * F.col("__n_words")))

    names = docs.columns

    def strip(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else [0] * len(texts)
            for k, runs in enumerate(batch.column("__runs").to_pylist()):
                if runs:
                    spans = [m.span() for m in WORD.finditer(lower(texts[k]))]
                    parts, at = [], 0
                    for a, b in zip(runs[::2], runs[1::2]):
                        parts.append(texts[k][at : spans[a][0]])
                        at = spans[b - 1][1]
                    texts[k] = "".join([*parts, texts[k][at:]])
                    sizes[k] = len(texts[k])
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.record_batch([cols[c] for c in names], names)

    return common.map_arrow(kept, strip, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    hit = F.when(F.size("runs") > 0, F.expr("aggregate(transform(sequence(1, size(runs), 2), i -> runs[i] - runs[i - 1]), 0L, (a, x) -> a + x)")).otherwise(F.lit(0).cast("bigint"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


#: Words joined by blanks; a window is found as a run of words inside blanks.
_WORDS = r"string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ')"
SQL = rf"""
WITH d AS (SELECT doc_id, [x FOR x IN {_WORDS} IF x <> ''] AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, [x FOR x IN {_WORDS} IF x <> ''] AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM bw),
dg AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dg.k AS k, item_id FROM dg JOIN bw ON dg.k = bw.k AND dg.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
