"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their pieces of four and five letters, hashed. The terms most associated with label 1
on the training rows make the vocabulary, so the cosine is that of these terms and not of whole texts;
their document counts over all documents give the IDF.
Labelled examples are indexed in blocks of ids, each block with the largest weight of every term in
it; a query visits blocks in order of the bound these give and stops when no block can still hold a
nearer example, so its neighbours are exact. Votes are weighted by similarity and calibrated on the
training examples, each scored without itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import pin, table

#: Labelled rows that the classifier is fitted on, at most (drawn by a hash of the id), and its vocabulary.
EXAMPLES, TERMS = 4000, 1500
#: Hashed terms; neighbours; ids in a block; number of examples that must carry a term, at most; bins of calibration.
SPACE, NEIGHBOURS, BLOCK, LEAST, BINS = 1 << 22, 15, 128, 8, 20
#: Words whose terms, and vectors whose votes, a worker remembers at most.
CACHED_WORDS, CACHED_VOTES = 300_000, 50_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _tokens(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def _word(token: str) -> str:
    return token.strip(".,;:!?\"'()*#%&$|<>[]")


def _words(text: str | None) -> set[str]:
    return {_word(t) for t in _tokens(text)}


def _terms(word: str) -> list[int]:
    b = [word[i : i + k] for k in (4, 5) for i in range(len(word) - k + 1)]
    return [zlib.crc32(t.encode("utf-8", "replace")) % SPACE for t in {*b, "=" + word}] if word else []


class _Features:
    """Numbers of the vocabulary's terms in a text and in how many of its distinct words each is; tokens are remembered."""

    def __init__(self, vocabulary: dict[int, int]):
        self.vocabulary = vocabulary
        # Tokens whose word has terms of the vocabulary, with word and terms, and tokens whose word has none.
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.blank: set[str] = set()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) + len(self.blank) > CACHED_WORDS:
            self.known.clear()
            self.blank.clear()
        found: dict[str, tuple[int, ...]] = {}
        for token in _tokens(text) - self.blank:
            got = self.known.get(token)
            if got is None:
                word = _word(token)
                terms = tuple(v for t in _terms(word) if (v := self.vocabulary.get(t)) is not None)
                if not terms:
                    self.blank.add(token)
                    continue
                got = self.known[token] = word, terms
            found[got[0]] = got[1]
        return np.unique(np.array([v for terms in found.values() for v in terms], np.int64), return_counts=True)


def _vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * idf[terms] if len(terms) else np.empty(0)
    norm = np.sqrt((weights**2).sum())
    return terms, weights / norm if norm else weights


class BlockMaxIndex:
    """Exact nearest neighbours by cosine among unit vectors (terms, weights)."""

    def __init__(self, vectors: list, n_terms: int, block: int = BLOCK):
        self.size, self.block, self.n_terms = len(vectors), block, n_terms
        n_blocks = -(-self.size // block)
        row = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        term = np.concatenate([np.asarray(t, np.int64) for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([np.asarray(w, float) for _, w in vectors]) if vectors else np.empty(0)
        self.most = np.zeros((n_terms, n_blocks), np.float32)
        np.maximum.at(self.most, (term, row // block), np.nextafter(weight.astype(np.float32), np.float32(np.inf)))
        # Postings by block, then term; starts[block * n_terms + term] is where a list begins.
        place = row // block * n_terms + term
        order = np.argsort(place, kind="stable")
        self.row, self.weight = row[order], weight[order]
        self.starts = np.searchsorted(place[order], np.arange(n_blocks * n_terms + 1))

    def _similarities(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of blocks (ascending) that share a term with the query, and their similarities."""
        lists = (blocks[:, None] * self.n_terms + terms[None, :]).ravel()
        first = self.starts[lists]
        length = self.starts[lists + 1] - first
        total = int(length.sum())
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(total)
        slot = np.searchsorted(blocks, self.row[at] // self.block) * self.block + self.row[at] % self.block
        got = np.bincount(slot, weights=np.repeat(np.tile(weights, len(blocks)), length) * self.weight[at], minlength=len(blocks) * self.block)
        hit = np.flatnonzero(got > 0)
        return blocks[hit // self.block] * self.block + hit % self.block, got[hit]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the k nearest of similarity above 0, ties by number."""
        if not len(terms) or not self.size:
            return np.empty(0, np.int64), np.empty(0)
        bounds = weights @ self.most[terms]
        visits = np.argsort(-bounds, kind="stable")
        visits = visits[bounds[visits] > 0]
        ids, sims, worst, at, step = np.empty(0, np.int64), np.empty(0), 0.0, 0, 2
        while at < len(visits):
            now = visits[at : at + step]
            if len(ids) >= k:  # a block or vector below the k-th by more than rounding cannot enter
                now = now[bounds[now] >= worst - 1e-6]
                if not len(now):
                    break
            at, step = at + step, 2 * step
            found, got = self._similarities(np.sort(now), terms, weights)
            keep = found != without
            if len(ids) >= k:
                keep &= got > worst - 1e-6
            ids, sims = np.concatenate([ids, found[keep]]), np.concatenate([sims, got[keep]])
            if len(ids) > k:
                best = np.lexsort((ids, -np.round(sims, 9)))[:k]
                ids, sims = ids[best], sims[best]
            if len(ids) >= k:
                worst = sims.min()
        order = np.lexsort((ids, -np.round(sims, 9)))
        return ids[order], sims[order]


def _alike_together(vectors: list) -> list[int]:
    """Order of vectors by their terms, heaviest first: blocks of similar vectors have low bounds for most queries."""
    return sorted(range(len(vectors)), key=lambda i: (vectors[i][0][np.lexsort((vectors[i][0], -vectors[i][1]))].tolist(), i))


class _Searcher:
    """Searches of an index, where a vector seen before is not searched again (but for an example's, which leaves itself out)."""

    def __init__(self, index: BlockMaxIndex, k: int):
        self.index, self.k, self.known = index, k, {}

    def __call__(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        if without >= 0:
            return self.index.search(terms, weights, self.k, without)
        key = terms.tobytes() + weights.tobytes()
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= CACHED_VOTES:
                self.known.clear()
            got = self.known[key] = self.index.search(terms, weights, self.k)
        return got


def _vote(ids: np.ndarray, sims: np.ndarray, labels: np.ndarray, base: float) -> float:
    """Share of label 1 among neighbours weighted by squared similarity; far neighbours leave weight to the base rate."""
    w = sims**2
    return float((w @ labels[ids] + 0.05 * base) / (w.sum() + 0.05)) if len(ids) else -1.0


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the vote, by pooling neighbours that violate order; then kept strictly rising."""
    order = np.argsort(votes, kind="stable")
    blocks: list[list[float]] = []
    for v, y in zip(votes[order], labels[order], strict=True):
        blocks.append([v, v, y, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            _, high, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + y2, blocks[-1][3] + n2]
    xs = np.array([(b[0] + b[1]) / 2 for b in blocks])
    return xs, np.array([(b[2] + 0.5 * 0.1) / (b[3] + 0.1) for b in blocks])


def _training(labels: DataFrame, id_col: str, examples: int) -> DataFrame:
    """Pinned _doc, y of at most `examples` labelled ids that are not held out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).filter(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_doc")).agg(F.max("toxic").alias("y"))
    return pin(known.orderBy(F.xxhash64("_doc"), "_doc").limit(examples), "chosen")


def toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, terms: int = TERMS
) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted, evidence (ids of the nearest examples).

    Only labels of rows whose id is not held out are learnt from, of at most `examples` of them. Null and
    empty texts, and texts without a term of the vocabulary, score the rate of label 1 among such examples.
    An example is scored without itself among the neighbours. Rows with one id are scored each for itself and
    are one example; a null id is not held out. Ids are integers. Without labels all scores are 0; an empty
    table gives an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    chosen_docs = F.broadcast(_training(labels, id_col, examples))  # at most `examples` pairs of numbers
    train = pin(docs.join(chosen_docs, F.col("doc") == F.col("_doc")).select("text", "y"), "examples")

    def count(batches):
        n, known = np.zeros((2, SPACE), np.int32), {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(known) > CACHED_WORDS // 4:
                    known.clear()
                words = _words(text)
                for w in words.difference(known):
                    known[w] = tuple(_terms(w))
                got: set[int] = set().union(*map(known.__getitem__, words))
                n[1 if y else 0, np.fromiter(got, np.int64, len(got))] += 1
        hit = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[0, hit].astype(np.int64)), pa.array(n[1, hit].astype(np.int64))], names=["term", "clean", "toxic"])

    totals = {int(r["y"] != 0): r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(totals.get(0, 0)), float(totals.get(1, 0))
    counts = train.select("text", "y").mapInArrow(count, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b = F.col("a"), F.col("b")
    rate = F.lit((n1 + 0.5) / (n0 + n1 + 1))
    expected = (a + b) * rate
    # Signed chi-square of a term with the label; only terms that lean to label 1 are kept. Few toxic examples ask for less support.
    chi = (b - expected) * F.abs(b - expected) / F.greatest(expected, F.lit(1e-9))
    least = min(LEAST, max(2, round(n1 / 20)))
    chosen = counts.filter((a + b) >= least).withColumn("chi", chi).filter("chi > 0").orderBy(F.col("chi").desc(), "term").limit(terms).collect()
    vocabulary = {r["term"]: i for i, r in enumerate(chosen)}
    shared = spark.sparkContext.broadcast(vocabulary)

    def extract(batches):
        features = _Features(shared.value)
        for batch in batches:
            out = [features(text) for text in batch.column(1).to_pylist()]
            if out:
                offsets = pa.array(np.cumsum([0, *[len(t) for t, _ in out]]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc", "terms", "counts"])

    # Each whole text is gone through once; counts, examples and scores are taken from these short lists.
    found = pin(docs.mapInArrow(extract, "doc long, terms array<int>, counts array<int>"), "features")

    def frequencies(batches):
        n = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(n))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(n[hit], pa.int64())], names=["term", "n"])

    df = found.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most `terms` rows
    seen = {r["term"]: r["n"] for r in df}
    idf = np.log((1 + found.count()) / (1 + np.array([seen.get(i, 0) for i in range(len(vocabulary))], float))) + 1 if vocabulary else np.zeros(0)

    # Of rows with one id the example is the first by its terms: at most `examples` documents' short lists.
    got = found.join(chosen_docs, F.col("doc") == F.col("_doc")).groupBy("doc", (F.col("y") != 0).cast("int").alias("y"))
    got = got.agg(F.min(F.struct("terms", "counts")).alias("v")).select("doc", "y", "v.*").orderBy("doc").collect()
    empty = {r["doc"]: r["y"] for r in got if not r["terms"]}
    got = [r for r in got if r["terms"]]
    unit = [_vector(np.array(r["terms"], np.int64), np.array(r["counts"], np.int64), idf) for r in got]
    order = _alike_together(unit)
    got, unit = [got[i] for i in order], [unit[i] for i in order]
    y = np.array([r["y"] for r in got], float)
    base = float(y.mean()) if len(y) else 0.0
    index = BlockMaxIndex(unit, len(vocabulary))
    examples_ = spark.sparkContext.broadcast((index, unit, y, base))

    def own_votes(batches):
        index, unit, y, base = examples_.value
        for batch in batches:
            i = batch.column(0).to_pylist()
            votes = [_vote(*index.search(*unit[j], NEIGHBOURS, without=j), y, base) for j in i]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(votes, pa.float64())], names=["i", "vote"])

    # One number for each of at most `examples` vectors, dealt out in short ranges as neighbours in order cost alike.
    own = spark.range(0, len(unit), 1, max(1, len(unit) // 500)).mapInArrow(own_votes, "i long, vote double").collect()
    votes = np.array([r["vote"] for r in sorted(own, key=lambda r: r["i"])], float)
    scored = votes >= 0
    xs, ys = _calibrate(votes[scored], y[scored]) if scored.any() else (np.array([0.0]), np.array([0.0]))
    model = spark.sparkContext.broadcast((index, y, base, xs, ys, empty, [r["doc"] for r in got]))

    def score(batches):
        index, y, base, xs, ys, empty, ids = model.value
        nearest, number = _Searcher(index, NEIGHBOURS), {doc: i for i, doc in enumerate(ids)}
        n, n_toxic = len(empty), sum(empty.values())
        for batch in batches:
            scores, evidence = [], []
            for doc, terms_, counts_ in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                terms_, weights = _vector(np.array(terms_, np.int64), np.array(counts_, np.int64), idf)
                near, sims = nearest(terms_, weights, number.get(doc, -1))
                vote = _vote(near, sims, y, base)
                # An example's own label is not an input of its score.
                own = doc in empty
                blank = (n_toxic - empty.get(doc, 0) + 0.05) / (n - own + 1) if ids or empty else 0.0
                # Calibrated, and by a thousandth still in the order of the votes.
                scores.append(blank if vote < 0 else min(1.0, max(0.0, 0.999 * float(np.interp(vote, xs, ys)) + 0.001 * vote)))
                evidence.append([ids[i] for i in near[:3]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc", "score", "evidence"])

    # The pinned lists are few and short files; searches want more tasks than these.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = found.repartition(parts, F.xxhash64("doc", "terms")).mapInArrow(score, "doc long, score double, evidence array<long>")
    return out.select(
        F.col("doc").alias(id_col), F.coalesce(held_out(F.col("doc")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def op5_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
