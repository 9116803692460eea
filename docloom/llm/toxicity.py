"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The classifier is fitted on a bounded sample of labelled rows (EXAMPLES of each class, by seeded hash). Every word of the
examples is a term of the index, whatever its count; IDF is multiplied by how strongly the word's presence goes with the label, a
shrunk log-odds ratio (see association) that no word is too rare for, so that words of a small language count as well. The
examples' unit vectors lie in an inverted index cut into blocks, with the greatest weight of every term in every block; a
query visits the blocks of highest upper bound, then those whose bound reaches its NEIGHBOURS-th best cosine, so its neighbours are
those of a full scan. Their votes, weighted by similarity, become a probability by isotonic regression of the examples' own
votes, weighted back to the classes' true shares. Those votes are of an index whose associations don't know the example's
label (FOLDS folds), so chance associations of rare words can't raise the calibrated probability.

Result: doc_id, toxicity (probability), toxic (0.5 or more) and evidence (the neighbours by falling cosine, ties: the smaller
doc_id; never the document itself) of every row, repeated rows included. Null text: toxicity, toxic and evidence null. A text
without any term of the index (empty, say) has no evidence and the share of toxic examples among such. A null doc_id is no bar to
a score. Labels that are null or without a document aren't fitted; of a doc_id labelled twice the greater label holds, of one with two texts the smaller.
Without labels every score is null. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import null_safe_columns
from docloom.llm._text import text_slices, words_of

EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 32
#: Matrix cells of the commonest terms, for each posting of the index.
DENSE_CELLS = 1
#: About as many texts, and postings of theirs, meet the index at once.
QUERIES = 64
POSTINGS = 1_000_000
FOLDS = 5
LEAST_ASSOCIATION = 0.01
FIRST_BLOCKS = 8
SCORES = "doc_id bigint, toxicity double, toxic boolean, evidence array<struct<doc_id:bigint,similarity:double,toxic:boolean>>"


def _counts(words: np.ndarray, first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each term's presence."""
    if not len(terms) or not len(words):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == words)
    rows = np.searchsorted(first, hit, "right") - 1
    pairs, counts = np.unique(rows * len(terms) + at[hit], return_counts=True)
    return pairs // len(terms), pairs % len(terms), counts


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each different word of each text, by row and hash; a slice of the texts at a time."""
    out, base = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in text_slices(pa.record_batch([texts], ["text"])):
        words, first = words_of(part.column(0))
        row = np.repeat(np.arange(base, base + part.num_rows), np.diff(first))
        order = np.lexsort([words, row])
        words, row = words[order], row[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (words[1:] != words[:-1])])) if len(words) else np.zeros(0, np.int64)
        out.append((row[new], words[new], np.diff(np.append(new, len(words)))))
        base += part.num_rows
    row, word, n = (np.concatenate(x) for x in zip(*out))
    return row, word, n


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] places, then those of the next."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def association(with_term: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How strongly each term's presence goes with the label: the log-odds ratio, shrunk by its own variance, never 0.

    with_term: examples of the two classes (rows) that have each term; size: of the classes.
    """
    seen, other = with_term + 0.5, size[:, None] - with_term + 0.5
    ratio = np.log(seen[1] / other[1]) - np.log(seen[0] / other[0])
    variance = (1 / seen + 1 / other).sum(0)
    return LEAST_ASSOCIATION + np.abs(ratio) * ratio**2 / (ratio**2 + variance)


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples (ids, labels) in blocks.

    Lists of the commonest terms lie block by block, with their greatest weight in every block, as whole matrices that take no more than
    DENSE_CELLS cells for each posting of the index; those of the other terms lie as postings by term.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, idf: np.ndarray, vectors: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray], block: int = BLOCK) -> None:
        """vectors: terms x examples, whole or as (term, example, weight) of what isn't 0; examples without a term are left out."""
        if not isinstance(vectors, tuple):
            t, x = np.nonzero(vectors)
            vectors = t, x, vectors[t, x]
        term, example, weight = vectors
        top = np.zeros(len(ids), np.int64)  # each example's term of most weight
        by_weight = np.argsort(weight, kind="stable")
        top[example[by_weight]] = term[by_weight]
        some = np.unique(example)
        order = some[np.lexsort([ids[some], top[some]])]  # alike ones in one block
        self.ids, self.labels, self.terms, self.idf, self.block = ids[order], labels[order], terms, idf, block
        self.place_of = {int(x): i for i, x in enumerate(self.ids)}
        place = np.zeros(len(ids), np.int64)
        place[order] = np.arange(len(order))
        place = place[example]
        self.n_blocks = max(1, -(-len(order) // block))
        width = self.n_blocks * block
        frequency = np.bincount(term, minlength=len(terms))
        common = np.argsort(-frequency, kind="stable")[: DENSE_CELLS * len(term) // width]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        whole = np.zeros((self.n_blocks, len(common), block))
        whole[place[dense] // block, self.row[term[dense]], place[dense] % block] = weight[dense]
        self.blocks, self.peaks = whole, np.ascontiguousarray(whole.max(2).T)
        by_term = np.flatnonzero(~dense)
        by_term = by_term[np.lexsort([place[by_term], term[by_term]])]
        self.places, self.weight = place[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(len(terms) + 1))

    def weights(self, query: np.ndarray, at: np.ndarray, counts: np.ndarray, n_queries: int) -> np.ndarray:
        """Unit TF-IDF weights of each query's terms."""
        w = (1 + np.log(counts)) * self.idf[at]
        return w / np.sqrt(np.bincount(query, w * w, n_queries))[query]

    def nearest(self, query: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, but: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (places 0, 1, ... of but) the places and cosines of the k nearest examples with a term in common, exactly.

        but: for each query a doc_id to pass over, or None.
        """
        postings = np.bincount(query, self.first[at + 1] - self.first[at], len(but))
        group = np.cumsum(np.maximum(postings / POSTINGS, 1 / QUERIES)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(but)]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in zip(cuts, cuts[1:]):
            a, b = np.searchsorted(query, [i, j])
            out += self._nearest(query[a:b] - i, at[a:b], w[a:b], k, but[i:j]) if j > i else []
        return out

    def _nearest(self, query: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, but: list) -> list[tuple[np.ndarray, np.ndarray]]:
        n, n_blocks, block = len(but), self.n_blocks, self.block
        width = n_blocks * block
        row = self.row[at]
        rare = np.flatnonzero(row < 0)
        sizes = self.first[at[rare] + 1] - self.first[at[rare]]
        hits = _ranges(self.first[at[rare]], sizes)
        near = np.bincount(np.repeat(query[rare] * width, sizes) + self.places[hits], np.repeat(w[rare], sizes) * self.weight[hits], n * width).reshape(n, n_blocks, block)
        common = np.flatnonzero(row >= 0)
        by_row = np.zeros((n, len(self.peaks)))
        by_row[query[common], row[common]] = w[common]
        bounds = by_row @ self.peaks + near.max(2)  # no cosine of the block is greater
        left, seen = bounds > 0, np.zeros((n, n_blocks), bool)
        without = [(i, self.place_of[x]) for i, x in enumerate(but) if x in self.place_of]
        out_row, out_place = (np.array([x[j] for x in without], np.int64) for j in range(2))

        def visit(now: np.ndarray) -> None:
            for b in np.flatnonzero(now.any(0)).tolist():
                who = np.flatnonzero(now[:, b])
                near[who, b] += by_row[who] @ self.blocks[b]
            near.reshape(n, width)[out_row, out_place] = 0

        # the blocks of highest bound, then all that can still matter
        first = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        now = np.zeros_like(seen)
        np.put_along_axis(now, first, True, 1)
        now &= left
        visit(now)
        seen |= now
        cosines = np.take_along_axis(np.where(now[:, :, None], near, 0), first[:, :, None], 1).reshape(n, -1)
        worst = np.partition(cosines, -k, axis=1)[:, -k] if cosines.shape[1] >= k else np.zeros(n)
        now = left & ~seen & (bounds + 2e-9 >= worst[:, None])
        visit(now)
        seen |= now
        near = np.round(np.where(seen[:, :, None], near, 0), 9).reshape(n, width)
        worst = np.partition(near, -k, axis=1)[:, -k] if width >= k else np.zeros(n)
        out = []
        for i in range(n):
            found = np.flatnonzero((near[i] >= worst[i]) & (near[i] > 0))
            found = found[np.lexsort([self.ids[found], -near[i, found]])[:k]]
            out.append((found, near[i, found]))
        return out


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the rising step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    knots, at = np.unique(x[order], return_inverse=True)
    weight, mean = np.bincount(at, w[order]), np.bincount(at, w[order] * y[order])
    pools: list[list[float]] = []
    for i in range(len(knots)):
        pools.append([mean[i], weight[i], 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, v, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + v, pools[-1][2] + n]
    return knots, np.repeat([s / v for s, v, _ in pools], [n for _, _, n in pools])


class ToxicityModel:
    def __init__(self, ids: list[int], texts: list[str] | pa.Array, labels: list[int], shares: tuple[float, float], neighbours: int = NEIGHBOURS) -> None:
        """shares: of the two classes among all labelled rows."""
        self.neighbours = neighbours
        y, ids_ = np.array(labels, np.int64), np.array(ids, np.int64)
        row, word, n = _bags(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        terms, at = np.unique(word, return_inverse=True)
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        idf = np.log((1 + len(texts)) / (1 + np.bincount(at, minlength=len(terms)))) + 1

        def index(known: np.ndarray) -> BlockMaxIndex:
            """Of all examples, weighted by the association with the labels of the known ones."""
            use = known[row]
            with_term = np.stack([np.bincount(at[use & (y[row] == c)], minlength=len(terms)) for c in (0, 1)]).astype(float)
            weight = idf * association(with_term, np.array([(y[known] == c).sum() for c in (0, 1)], float))
            vector = (1 + np.log(n)) * weight[at]
            norm = np.sqrt(np.bincount(row, vector * vector, len(texts)))
            return BlockMaxIndex(ids_, y, terms, weight, (at, row, vector / norm[row]))

        self.index = index(np.ones(len(texts), bool))
        weight = np.array([s / max(1, (y == c).sum()) for c, s in enumerate(shares)])[y]
        bare = np.diff(cuts) == 0
        self.bare = float((weight * y)[bare].sum() / weight[bare].sum()) if bare.any() else (shares[1] / max(1e-300, sum(shares)))
        votes = np.full(len(texts), np.nan)
        fold = np.zeros(len(texts), np.int64)
        for c in (0, 1):  # folds of both classes alike
            fold[y == c] = np.arange((y == c).sum()) % FOLDS
        for f in range(FOLDS):
            blind = index(fold != f)
            mine = np.flatnonzero((fold == f) & ~bare)
            sizes = cuts[mine + 1] - cuts[mine]
            own, query = _ranges(cuts[mine], sizes), np.repeat(np.arange(len(mine)), sizes)
            found = blind.nearest(query, at[own], blind.weights(query, at[own], n[own], len(mine)), neighbours, ids_[mine].tolist())
            votes[mine] = [self.vote(*x, blind) for x in found]
        known = ~np.isnan(votes)
        self.knots, self.values = _isotonic(votes[known], y[known].astype(float), weight[known]) if known.any() else (np.zeros(0), np.zeros(0))

    def vote(self, places: np.ndarray, cosines: np.ndarray, index: BlockMaxIndex | None = None) -> float:
        return float((cosines * (index or self.index).labels[places]).sum() / cosines.sum()) if len(places) else float("nan")

    def scores(self, ids: list, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Probability, and places and cosines of the evidence, of each text."""
        rows, at, counts = _counts(*words_of(texts), self.index.terms)
        found = self.index.nearest(rows, at, self.index.weights(rows, at, counts, len(ids)), self.neighbours, ids)
        votes = np.array([self.vote(*x) for x in found])
        known = ~np.isnan(votes)
        scores = np.full(len(ids), self.bare)
        if len(self.knots):
            scores[known] = np.interp(votes[known], self.knots, self.values)
        return scores, found


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, seed: int = 41) -> ToxicityModel | None:
    """Fitted on examples labelled rows of each class; None without labels."""
    known = null_safe_columns(labels, {"doc_id": "bigint", "toxic": "int"}).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by_hash = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 0").orderBy(*by_hash).limit(examples).unionByName(known.where("toxic = 1").orderBy(*by_hash).limit(examples))
    texts = null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).where("text is not null")
    # 2 * examples rows at most
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    whole = sum(shares.values())
    ids, texts_, toxic = rows["doc_id"].to_pylist(), rows["text"].combine_chunks(), rows["toxic"].to_pylist()
    return ToxicityModel(ids, texts_, toxic, (shares.get(0, 0) / whole, shares.get(1, 0) / whole), neighbours)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, **options) -> DataFrame:
    """See the module."""
    model = model or fit(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def evidence_of(found: list[tuple[np.ndarray, np.ndarray]], valid: np.ndarray) -> pa.Array:
        """A list for each text, null where there is none."""
        some = [x if v else x[:0] for (x, _), v in zip(found, valid)]
        places = np.concatenate([np.zeros(0, np.int64), *some])
        cosines = np.concatenate([np.zeros(0), *[c if v else c[:0] for (_, c), v in zip(found, valid)]])
        index = sent.value.index if sent.value is not None else None
        ids, labels = (index.ids[places], index.labels[places] == 1) if index is not None else (places, places == 1)
        rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(cosines), pa.array(labels)], ["doc_id", "similarity", "toxic"])
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in some], dtype=np.int64)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~valid, False)), rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in text_slices(batch):
                n = part.num_rows
                if model is None:
                    valid, scores, found = np.zeros(n, bool), np.zeros(n), [(np.zeros(0, np.int64), np.zeros(0))] * n
                else:
                    valid = np.asarray(part.column(1).is_valid())
                    scores, found = model.scores(part.column(0).to_pylist(), part.column(1))
                yield pa.record_batch([part.column(0), pa.array(scores, mask=~valid), pa.array(scores >= 0.5, mask=~valid), evidence_of(found, valid)], ["doc_id", "toxicity", "toxic", "evidence"])

    return null_safe_columns(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(score, SCORES)
