"""Problem 7: evaluation texts leaking into training text, by latent semantic retrieval.

Passages of the documents and of the items become TF-IDF vectors over the items' words; a distributed
randomised SVD gives their latent space; passages near an item's passage by cosine are candidates; a
longest common run of words decides verbatim leaks, a longest common subsequence with an answer check
paraphrases.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.llm.spread import spread
from chainlake.storage import Scratch

_INVISIBLE = r"[\p{Cf}\p{Default_Ignorable_Code_Point}]"
_WORD = r"[^\W_]+"


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, after NFKC, without invisible characters, case folded."""
    if not text:
        return []
    if text.isascii():
        return re.findall("[a-z0-9]+", text.lower())
    text = regex.sub(_INVISIBLE, "", unicodedata.normalize("NFKC", text))
    text = unicodedata.normalize("NFKC", text.casefold())
    return regex.findall(_WORD, text.lower())


def windows(n: int, run: int) -> list[tuple[int, int]]:
    """Bounds of passages of 2 * run words, every run words: each stretch of run words lies whole in one of them."""
    return [(k, min(n, k + 2 * run)) for k in range(0, max(1, n - run), run)]


class Items:
    """The test items: their words as numbers, passages, and the runs that give each away.

    The items are a stated query set. All share one vocabulary, one table of word weights and one latent space;
    block() gives the part whose passages and runs one search holds in memory.
    """

    def __init__(self, rows: list[tuple[int, str]], run: int):
        self.run = run
        texts = [(i, words(t)) for i, t in rows]
        texts = [(i, w) for i, w in texts if w]
        self.vocabulary: dict[str, int] = {}
        self.ids = np.array([i for i, _ in texts], dtype=np.int64)
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64) for _, w in texts]
        self.passages: list[np.ndarray] = []
        owner = []
        for k, w in enumerate(self.words):
            for s, e in windows(len(w), run):
                self.passages.append(w[s:e])
                owner.append(k)
        self.owner = np.array(owner, dtype=np.int64)
        self.shortest = min((len(w) for w in self.words), default=run)
        self.answer = np.zeros(len(self.vocabulary), dtype=bool)  # figures and coded names: words with a digit
        for x, k in self.vocabulary.items():
            self.answer[k] = any(c.isdigit() for c in x)
        self.runs: dict[int, dict[bytes, list[int]]] = {}
        self.sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ids)

    def least_words(self, share: float) -> int:
        """A stretch of fewer item words than this holds neither a run nor the subsequence of a paraphrase of any item."""
        return min([self.run, self.shortest, *(math.ceil(share * len(p)) for p in self.passages)])

    def block(self, start: int, stop: int) -> Items:
        """Items start..stop with their runs; vocabulary and numbers stay the same."""
        part = object.__new__(Items)
        part.run, part.vocabulary, part.answer, part.ids, part.words = self.run, self.vocabulary, self.answer, self.ids[start:stop], self.words[start:stop]
        mine = np.flatnonzero((self.owner >= start) & (self.owner < stop))
        part.passages, part.owner = [self.passages[k] for k in mine], self.owner[mine] - start
        part.runs = {}
        for k, w in enumerate(part.words):
            size = min(self.run, len(w))
            table = part.runs.setdefault(size, {})
            for s in range(len(w) - size + 1):
                held = table.setdefault(w[s : s + size].tobytes(), [])
                if not held or held[-1] != k:
                    held.append(k)
        # runs as sums of their words times fixed odd numbers: a quick test of many stretches at once
        part.factors = np.random.default_rng(7).integers(1, 1 << 63, self.run, dtype=np.uint64) | np.uint64(1)
        part.sums = {n: np.unique((np.stack([np.frombuffer(r, dtype=np.int64) for r in t]).astype(np.uint64) + np.uint64(1)) @ part.factors[:n]) for n, t in part.runs.items() if t}
        return part

    def shared_runs(self, wide: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Passage, place and length of stretches that may be a run of an item: none is missed, equal sums are to be looked up."""
        if not len(wide):
            return
        known = np.concatenate([np.zeros((len(wide), 1), dtype=np.int64), np.cumsum(wide >= 0, axis=1)], axis=1)
        plus = (wide.astype(np.int64) + 1).astype(np.uint64)
        for size, sums in sorted(self.sums.items()):
            n = wide.shape[1] - size + 1
            if n < 1:
                continue
            total = np.zeros((len(wide), n), dtype=np.uint64)
            for j in range(size):
                total += plus[:, j : j + n] * self.factors[j]
            whole = known[:, size:] - known[:, :-size] == size
            for r, k in zip(*(x.tolist() for x in np.nonzero(whole & np.isin(total, sums))), strict=True):
                yield r, k, size


def document_terms(documents: DataFrame, items: Items, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, terms): the documents' whole texts as numbers of item words (-1: no word of any item). Documents with fewer than `least` item words are left out; null and empty texts have no row."""
    vocabulary = items.vocabulary

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                return -1

        get = Numbers(vocabulary).__getitem__
        for batch in batches:
            keys, parts = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = np.fromiter(map(get, words(t)), dtype=np.int32)
                if np.count_nonzero(terms >= 0) >= least:
                    keys.append(k)
                    parts.append(terms)
            if keys:
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in parts])]), pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], names=["key", "terms"])

    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return spread(rows).mapInArrow(number, "key bigint, terms array<int>")


class Passages:
    """The passages of a batch of documents: 2 * run words every run words, as chunks of run words of which each is in two passages.

    A passage with fewer than `least` item words in itself and the run words on either side cannot hold a leak, and is left out.
    """

    def __init__(self, terms: list[np.ndarray], run: int, least: int):
        sizes = np.array([len(t) for t in terms])
        n_chunks = -(-sizes // run)
        n_passages = np.maximum(1, -(-(sizes - run) // run))
        first = np.concatenate([[0], np.cumsum(n_chunks + 3)]) + 1  # an empty chunk before and two after each document
        self.chunks = np.full((int(first[-1]) + 2, run), -1, dtype=np.int32)
        flat = self.chunks.reshape(-1)
        for k, t in enumerate(terms):
            flat[first[k] * run : first[k] * run + len(t)] = t
        self.row = np.repeat(np.arange(len(terms)), n_passages)
        self.at = first[self.row] + np.arange(len(self.row)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
        known = (self.chunks >= 0).sum(axis=1)
        keep = known[self.at - 1] + known[self.at] + known[self.at + 1] + known[self.at + 2] >= least
        self.row, self.at = self.row[keep], self.at[keep]

    def __len__(self) -> int:
        return len(self.at)

    def words(self, which: np.ndarray | slice = slice(None), around: bool = False) -> np.ndarray:
        """Term matrix of passages, or of the passages and their surroundings."""
        at = self.at[which]
        return np.concatenate([self.chunks[at + d] for d in ((-1, 0, 1, 2) if around else (0, 1))], axis=1)


def _sum_rows(table: np.ndarray, chunks: np.ndarray, step: int = 512) -> np.ndarray:
    """Sum of the table's rows that each chunk names; the table's last row is of zeros, for -1."""
    out = np.zeros((len(chunks), table.shape[1]), dtype=np.float32)
    held = np.empty((step, table.shape[1]), dtype=np.float32)
    for s in range(0, len(chunks), step):
        part = chunks[s : s + step]
        onto = out[s : s + step]
        for j in range(chunks.shape[1]):
            onto += np.take(table, part[:, j], axis=0, out=held[: len(part)], mode="wrap")
    return out


def _lengths(wide: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """One over the length of each passage's TF-IDF row (0 for rows without a word)."""
    order = np.sort(wide, axis=1)
    weight = np.append(idf, 0.0).astype(np.float64)[order] ** 2
    # equal words lie side by side: n of them weigh n² in the square of the length
    square = np.zeros(len(wide))
    same = np.ones(len(wide))
    for j in range(order.shape[1]):
        if j:
            same = np.where(order[:, j] == order[:, j - 1], same + 1, 1)
        square += weight[:, j] * (2 * same - 1) * (order[:, j] >= 0)
    return np.where(square > 0, 1 / np.sqrt(np.maximum(square, 1e-24)), 0)


def _gram_part(parts: Passages, idf: np.ndarray, table: np.ndarray, onto: np.ndarray) -> None:
    """Adds Aᵀ(A right) of the TF-IDF rows A of these passages to onto; table holds the rows of right times idf, and zeros."""
    scale = _lengths(parts.words(), idf)
    sums = _sum_rows(table, parts.chunks)
    y = (sums[parts.at] + sums[parts.at + 1]) * (scale**2)[:, None].astype(np.float32)
    z = np.zeros_like(sums)
    z[parts.at] += y  # no passage starts at the same chunk as another
    z[parts.at + 1] += y
    for s in range(0, len(z), 2048):
        words_here = parts.chunks[s : s + 2048]
        row, column = np.nonzero(words_here >= 0)
        if not len(row):
            continue
        term = words_here[row, column]
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(term[order]) > 0]))
        which = term[order][starts]
        onto[which] += np.add.reduceat(z[s + row[order]], starts, axis=0) * idf[which][:, None]


def _lists(col: pa.Array) -> list[np.ndarray]:
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))])
    return [flat[ends[k] : ends[k + 1]] for k in range(len(col))]


def _portions(terms: list[np.ndarray], most: int = 100_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Start and documents of stretches of about so many words, which bounds what a task holds."""
    start, n = 0, 0
    for k, t in enumerate(terms):
        if n and n + len(t) > most:
            yield start, terms[start:k]
            start, n = k, 0
        n += len(t)
    if len(terms) > start:
        yield start, terms[start:]


def _summed(documents: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """The sum over all documents of what add(terms, onto) adds. Each task's part is cut into stripes, which are summed by number, so no task gets all parts; one matrix reaches the driver."""
    stripes = 16

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, terms in _portions(_lists(batch.column(0))):
                add(terms, total)
        for k, x in enumerate(np.array_split(total.reshape(-1), stripes)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(m.as_buffer())
                total[k] = total[k] + x if k in total else x.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["k", "m"])

    merged = documents.select("terms").mapInArrow(part, "k int, m binary").repartition(stripes, "k").mapInArrow(merge, "k int, m binary")
    held = {r["k"]: np.frombuffer(r["m"]) for r in merged.collect()}  # one row a stripe
    return np.concatenate([held[k] for k in range(stripes)]).reshape(shape) if held else np.zeros(shape)


def _table(idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.concatenate([idf[:, None] * right, np.zeros((1, right.shape[1]))]).astype(np.float32)


def latent_space(documents: DataFrame, items: Items, idf: np.ndarray, least: int, rank: int, over: int = 16, passes: int = 2, seed: int = 17) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF matrix A of all passages of documents and items, by randomised SVD.

    Each pass multiplies an orthogonal block Q by AᵀA over the distributed rows. The last product Y = AᵀA Q gives the
    vectors without another pass, by the published Nyström form AᵀA ≈ Y (QᵀY)⁻¹ Yᵀ with a small shift.
    """
    v, run = len(items.vocabulary), items.run
    width = min(v, rank + over)
    block = np.random.default_rng(seed).standard_normal((v, width))
    for _ in range(passes):
        q = np.linalg.qr(block)[0]
        table = _table(idf, q)
        block = _summed(documents, (v, width), lambda terms, onto, table=table: _gram_part(Passages(terms, run, least), idf, table, onto))
        _gram_part(Passages(items.words, run, 0), idf, table, block)
    shift = 1e-7 * np.linalg.norm(block)
    moved = block + shift * q
    inner = q.T @ moved
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    half = moved @ (vectors / np.sqrt(np.maximum(values, shift * 1e-3)))
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two passages; -1 agrees with nothing."""
    before = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        if x < 0:
            continue
        found = np.maximum(before[1:], (before[:-1] + 1) * (b == x))
        before = np.concatenate([[0], np.maximum.accumulate(found)])
    return int(before[-1])


def common_subsequences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """common_subsequence() of the rows of two matrices, pair by pair; words that don't stand in the other agree with nothing."""
    before = np.zeros((len(a), b.shape[1] + 1), dtype=np.int16)
    for k in range(a.shape[1]):
        x = a[:, k : k + 1]
        found = np.where((b == x) & (x >= 0), before[:, :-1] + 1, 0)
        before[:, 1:] = np.maximum.accumulate(np.maximum(found, before[:, 1:]), axis=1)
    return before[:, -1].astype(np.int64)


def _unbroken(known: np.ndarray) -> np.ndarray:
    """Length of the longest stretch of true values of each row."""
    best = now = np.zeros(len(known), dtype=np.int64)
    for j in range(known.shape[1]):
        now = (now + 1) * known[:, j]
        best = np.maximum(best, now)
    return best


def _search(items: Items, idf: np.ndarray, basis: np.ndarray, near: float, paraphrase: float, share: float, least: int):
    """mapInArrow: documents' terms to (key, item, cosine, verbatim, subsequence share).

    Passages of document and item can be out of step by half a run, so a paraphrase is tested on the words around the passage.
    """
    lengths = np.array([len(p) for p in items.passages])
    wide = np.full((len(lengths), lengths.max()), len(items.vocabulary), dtype=np.int32)
    shortest = min(items.runs)
    for c, p in enumerate(items.passages):
        wide[c, : len(p)] = p
    asked = np.append(items.answer, False)[wide]
    table = _table(idf, basis)
    # each item passage under its rarest answer, without which nothing is a paraphrase of it; those without answers under no word
    rare = np.array([p[items.answer[p]][idf[p[items.answer[p]]].argmax()] if items.answer[p].any() else len(idf) for p in items.passages])
    by_word = np.argsort(rare, kind="stable")
    n_under = np.append(np.bincount(rare, minlength=len(idf) + 1), 0)  # the last two: no answer, and -1
    first_under = np.cumsum(n_under) - n_under
    always = by_word[first_under[len(idf)] : first_under[len(idf)] + n_under[len(idf)]]
    n_under[len(idf)] = 0

    def asking(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of passages of documents and items of which the first, or its surroundings, holds the other's rarest answer."""
        row, column = np.nonzero(n_under[around] > 0)
        word = around[row, column]
        n = n_under[word]
        at = np.repeat(first_under[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        left, right = np.repeat(row, n), by_word[at]
        if len(always):
            left, right = np.concatenate([left, np.repeat(np.arange(len(around)), len(always))]), np.concatenate([right, np.tile(always, len(around))])
        return left, right

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets = unit(np.stack([table[p].sum(axis=0) for p in items.passages])).T.copy()
        firsts = np.searchsorted(items.owner, np.arange(len(items) + 1))  # an item's passages are neighbours
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            found: dict[tuple[int, int], list] = {}

            def note(key: int, item: int, cosine: float, verbatim: bool, part: float) -> None:
                old = found.setdefault((key, item), [cosine, verbatim, part])  # noqa: B023
                old[:] = max(old[0], cosine), old[1] or verbatim, max(old[2], part)

            for start, terms in _portions(_lists(batch.column(1))):
                parts = Passages(terms, items.run, least)
                sums = _sum_rows(table, parts.chunks)
                for s in range(0, len(parts), 4096):
                    mine, around = parts.words(slice(s, s + 4096)), parts.words(slice(s, s + 4096), around=True)
                    whole = _unbroken(mine >= 0) >= shortest
                    rows = np.flatnonzero(whole | (n_under[around] > 0).any(axis=1) | bool(len(always)))  # the others hold neither a run nor any passage's rarest answer
                    if not len(rows):
                        continue
                    at = parts.at[s + rows]
                    cosine = unit(sums[at] + sums[at + 1]) @ targets
                    near_ones = np.flatnonzero(cosine.max(axis=1) >= near)
                    if len(near_ones) < len(cosine):
                        cosine = cosine[near_ones]
                    rows = rows[near_ones]
                    owners, mine, around = keys[start + parts.row[s + rows]], mine[rows], around[rows]
                    whole = np.flatnonzero(whole[rows])
                    for r, k, size in items.shared_runs(mine[whole]):
                        r = whole[r]
                        for o in items.runs[size].get(mine[r, k : k + size].astype(np.int64).tobytes(), ()):
                            best = cosine[r, firsts[o] : firsts[o + 1]].max()
                            if best >= near:
                                note(int(owners[r]), o, float(best), True, 1.0)
                    left, right = asking(around)
                    alike = cosine[left, right] >= paraphrase
                    left, right = left[alike], right[alike]
                    for t in range(0, len(left), 2048):
                        r, c = left[t : t + 2048], right[t : t + 2048]
                        here, place = np.unique(r, return_inverse=True)
                        there = np.zeros((len(here), len(idf) + 2), dtype=bool)  # which words stand around each passage; the last two columns are of no word
                        there[np.arange(len(here))[:, None], around[here]] = True
                        there[:, -2:] = False
                        held = there[place[:, None], wide[c]]  # a common subsequence has no more words than are there at all
                        ok = (held.sum(axis=1) >= share * lengths[c]) & (held | ~asked[c]).all(axis=1)
                        r, c = r[ok], c[ok]
                        part = common_subsequences(around[r], wide[c]) / lengths[c]
                        enough = np.flatnonzero(part >= share)
                        for k in enough.tolist():
                            note(int(owners[r[k]]), int(items.owner[c[k]]), float(cosine[r[k], c[k]]), False, float(part[k]))
            if found:
                ks, vs = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in ks], pa.int64()), pa.array([int(items.ids[o]) for _, o in ks], pa.int64()), *(pa.array([v[i] for v in vs]) for i in range(3))],
                    names=["key", "item_id", "cosine", "verbatim", "share"],
                )

    return run


def leaking_documents(
    documents: DataFrame,
    items: DataFrame,
    run: int = 13,
    rank: int = 128,
    near: float = 0.15,
    paraphrase: float = 0.3,
    share: float = 0.7,
    block_items: int = 2000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, item_id, cosine, kind, subsequence_share): every document with every item that it leaks.

    kind is "verbatim" where document and item have `run` consecutive words in common (all words of a
    shorter item), else "paraphrase" where a passage is near by cosine (paraphrase; `near` at least) and it
    with its neighbours shares `share` of the item passage's words as a common subsequence and holds all its
    answers (words with a digit: figures and coded names). Word frequencies and the latent
    space come from all passages of all documents and of all items, so they do not depend on block_items, the number
    of items whose passages a task holds at a time. The items are a stated query set whose words the driver holds.
    Null, empty and wordless texts leak nothing; equal documents are reported each; no rows give no rows.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    rows = items.where("item_id IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").collect()
    every = Items([(r[0], r[1]) for r in rows], run)
    if not len(every):
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, kind string, subsequence_share double")
    least = every.least_words(share)
    terms = scratch.save(document_terms(documents, every, least), "terms", rows_per_file=5_000)  # much work a row: small files spread it
    v = len(every.vocabulary)

    def count(lists: list[np.ndarray], onto: np.ndarray) -> None:
        parts = Passages(lists, run, least)
        for s in range(0, len(parts), 4096):
            order = np.sort(parts.words(slice(s, s + 4096)), axis=1)
            new = np.concatenate([order[:, :1] >= 0, (order[:, 1:] != order[:, :-1]) & (order[:, 1:] >= 0)], axis=1)
            onto[:v] += np.bincount(order[new], minlength=v)
        onto[v] += len(parts)

    frequency = _summed(terms, (v + 1,), count)
    for p in every.passages:
        frequency[np.unique(p)] += 1
    total = frequency[v] + len(every.passages)
    idf = np.log1p(total / (1 + frequency[:v]))
    basis = latent_space(terms, every, idf, least, rank)
    found = None
    for start in range(0, len(every), block_items):
        search = _search(every.block(start, start + block_items), idf, basis, near, max(near, paraphrase), share, least)
        part = terms.mapInArrow(search, "key bigint, item_id bigint, cosine double, verbatim boolean, share double")
        found = part if found is None else found.unionByName(part)
    each = found.where(F.col("verbatim") | (F.col("share") >= share))
    each = each.groupBy("key", "item_id").agg(F.max("cosine").alias("cosine"), F.max("verbatim").alias("verbatim"), F.max("share").alias("subsequence_share"))
    return each.select(F.col("key").alias("doc_id"), "item_id", F.round("cosine", 4).alias("cosine"), F.when(F.col("verbatim"), "verbatim").otherwise("paraphrase").alias("kind"), "subsequence_share")
