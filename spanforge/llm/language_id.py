"""Language ID by prediction by partial matching (PPM).

One byte context tree a language, of variable order up to 4: the count of each
byte after each context of four bytes to none, over all 256 byte values.  A byte
that a context has seen costs ``-log2(c / (n + d))`` bits there; one it has not
seen costs an escape, ``-log2(d / (n + d))``, and is coded by the next shorter
context (method C: d distinct successors in n); below order 0 all bytes are
equally likely.  The statistics are frozen after training, so the code length of a
byte depends on it and the four bytes before it alone: trees are unfolded into the
exact code length of each edge and the escape of each context, in all languages at
once, and a text's code length is a sum of look-ups over all its bytes.  The
language of the shortest code wins; the score is its share when code lengths are
taken as probabilities, ``2 ** -bits``.

Training uses a hash sample of about ``per_language`` labelled documents of each
language, whole texts.  Counting is distributed.  All trees together have at most
``edges`` edges, an equal share a language: one with more loses those seen fewer
than 2, 4, 8, ... times (a shorter edge is seen at least as often as a longer one
that ends in it, so trees stay whole and only become shallower).

Defined results: a null text or one without a letter is ``und`` with score 0, and
so is every text if nothing can be learned; a tie goes to the first language by
code point; a null lang is not learned from; a null doc_id hashes as '' (never
held out); repeated rows get equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
ORDER = 4
_START = b"\xff" * ORDER  # before the first byte of a text; 0xff is no byte of UTF-8
_STEP = 1 << 20


def _parts(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A text in parts of bounded size, each after the four bytes before it."""
    for i in range(0, len(text), _STEP):
        yield text[max(i - ORDER, 0) : i].rjust(ORDER, _START[:1]), text[i : i + _STEP]


def _keys(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Each byte of the parts with the four before it, as one number, its own lowest."""
    data = np.frombuffer(b"".join(x for part in parts for x in part), np.uint8).astype(np.int64)
    out = data.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= data[:-k] << (8 * k)
    ends = np.cumsum([ORDER + len(own) for _, own in parts])
    mine = np.ones(len(data), bool)
    mine[(np.concatenate([[0], ends[:-1]])[:, None] + np.arange(ORDER)).ravel().astype(int)] = False
    return out[mine]


def _at_order(keys: np.ndarray, k: int) -> np.ndarray:
    """Edges of order k: k bytes of context and a byte, under the mark of their order."""
    return keys & ((1 << 8 * (k + 1)) - 1) | k << 8 * (ORDER + 1)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all orders, ascending, and their counts."""
    edge, n = np.unique(keys, return_counts=True)
    edges, counts = [], []
    for k in range(ORDER + 1):
        own, back = np.unique(_at_order(edge, k), return_inverse=True)
        edges.append(own)
        counts.append(np.bincount(back, n, len(own)).astype(np.int64))
    return np.concatenate(edges), np.concatenate(counts)


def _edge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in common.slices(whole)):
        by_language: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), common.octets(batch.column("text")), strict=True):
            by_language.setdefault(lang, []).append(text)
        for lang, texts in by_language.items():
            for parts in _packed(texts):
                edge, n = counted(_keys(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(edge), pa.string()), common.longs(edge), common.longs(n)], names=["lang", "edge", "n"])


def _packed(texts: list[bytes]) -> Iterator[list[tuple[bytes, bytes]]]:
    """Parts of the texts in lists of bounded size."""
    held: list[tuple[bytes, bytes]] = []
    size = 0
    for part in (p for text in texts for p in _parts(text)):
        if held and size + len(part[1]) > _STEP:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part[1])
    if held:
        yield held


class _Places:
    """Where each of some different numbers stands among them (open addressing)."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.bits = max(4, int(2 * len(numbers)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(numbers), dtype=np.int32)
        at = self._home(numbers)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def _home(self, numbers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it is none of them."""
        out = np.full(len(wanted), -1, np.int32)
        todo, at = np.arange(len(wanted)), self._home(wanted)
        while len(todo) and len(self.numbers):
            place = self.slots[at]
            found = (place >= 0) & (self.numbers[place] == wanted[todo])
            out[todo[found]] = place[found]
            left = (place >= 0) & ~found
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)
        return out


class Model:
    """Frozen trees, unfolded: from edges of all orders and their counts, a pair a
    language, the code length of each edge and the escape of each context."""

    def __init__(self, trees: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(trees)
        edges, bits, contexts, escapes = [], [], [], []
        for k in range(ORDER + 1):
            own = []
            for x in self.languages:
                edge, n = trees[x]
                here = edge >> 8 * (ORDER + 1) == k
                order = np.argsort(edge[here])
                own.append((edge[here][order], n[here][order]))
            union = np.unique(np.concatenate([e for e, _ in own]))
            heads = np.unique(union >> 8)
            escape = np.zeros((len(heads), len(own)))
            if k:
                shorter = bits[-1][np.searchsorted(edges[-1], _at_order(union, k - 1))]
            else:
                shorter = np.full((len(union), len(own)), 8.0)
            seen = []
            for i, (edge, n) in enumerate(own):
                head, first, kinds = np.unique(edge >> 8, return_index=True, return_counts=True)
                total = np.add.reduceat(n, first) if len(first) else n
                escape[np.searchsorted(heads, head), i] = -np.log2(kinds / (total + kinds))
                seen.append(-np.log2(n / np.repeat(total + kinds, kinds)))
            length = shorter + escape[np.searchsorted(heads, union >> 8)]
            for i, (edge, _) in enumerate(own):
                length[np.searchsorted(union, edge), i] = seen[i]
            edges.append(union)
            bits.append(length)
            contexts.append(heads)
            escapes.append(escape)
        self.edges, self.contexts = np.concatenate(edges), np.concatenate(contexts)
        self.lengths, self.escapes = (np.concatenate(z).astype(np.float32) for z in (bits, escapes))
        self._places = None

    def __getstate__(self):
        return {**self.__dict__, "_places": None}

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language."""
        if self._places is None:
            self._places = _Places(self.edges), _Places(self.contexts)
        edges, contexts = self._places
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            edge = _at_order(keys[todo], k)
            at = edges.find(edge)
            out[todo[at >= 0]] += self.lengths[at[at >= 0]]
            todo, edge = todo[at < 0], edge[at < 0]
            at = contexts.find(edge >> 8)
            out[todo[at >= 0]] += self.escapes[at[at >= 0]]
        out[todo] += 8.0
        return out

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of a text in each language."""
        return self.many([text])[0]

    def many(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of texts."""
        out = np.zeros((len(texts), len(self.languages)))
        owner = [i for i, text in enumerate(texts) for _ in range(0, len(text), _STEP)]
        done = 0
        for parts in _packed(texts):
            starts = np.cumsum([0] + [len(own) for _, own in parts])[:-1]
            sums = np.add.reduceat(self._costs(_keys(parts)), starts, axis=0, dtype=np.float64)
            np.add.at(out, owner[done : done + len(parts)], sums)
            done += len(parts)
        return out


def _sampled(labelled: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about so many documents of each language, and the languages."""
    rows = labelled.where("lang is not null").select(F.coalesce(labelled["doc_id"].cast("string"), F.lit("")).alias("i"), common.text_of(labelled).alias("text"), F.col("lang").cast("string").alias("lang"))
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(number.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("i", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text"), sorted(number)


def train(labelled: DataFrame, per_language: int = 2000, edges: int = 1 << 19) -> Model | None:
    """A model from (doc_id, text, lang) rows; None if there are none to learn from."""
    some, languages = _sampled(labelled, per_language)
    if not languages:
        return None
    counts = some.mapInArrow(_edge_counts, "lang string, edge long, n long").groupBy("lang", "edge").agg(F.sum("n").alias("n"))
    counts = common.settle(counts, f"{common.scratch(labelled.sparkSession, 'language')}/edges")
    power = F.floor(F.log2(F.col("n").cast("double")) + 1e-9).cast("int")
    sizes: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("lang", power.alias("power")).agg(F.count(F.lit(1)).alias("edges")).collect():
        sizes.setdefault(r["lang"], {})[r["power"]] = r["edges"]
    least = F.lit(0)
    for lang, have in sorted(sizes.items()):
        cut = next(p for p in range(65) if sum(n for q, n in have.items() if q >= p) <= edges // len(languages))
        least = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(least)
    table = counts.where(power >= least).toArrow()  # ``edges`` rows at most
    lang = np.array(table.column("lang").to_pylist(), dtype=object)
    edge, n = table.column("edge").to_numpy(), table.column("n").to_numpy()
    trees = {x: (edge[lang == x], n[lang == x]) for x in languages if (lang == x).any()}
    return Model(trees) if trees else None


_models: dict[int, Model] = {}


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _models:
            _models.clear()
            _models[shared.id] = shared.value
        model = _models[shared.id]
        names = np.array(model.languages, dtype=object)
        for batch in (part for whole in batches for part in common.slices(whole)):
            texts = common.octets(batch.column("text"))
            bits = model.many(texts)
            size = np.maximum([len(t) for t in texts], 1)
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            with np.errstate(under="ignore"):
                rest = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)).sum(axis=1) if len(bits) else np.zeros(0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best].tolist(), pa.string()), pa.array(1 / rest), pa.array(bits.min(axis=1) / size)], names=[*keep, "lang_pred", "score", "rate"])

    return run


class _Shared:
    """A broadcast model; ``id`` names it in a worker's memory."""

    def __init__(self, context, model: Model):
        self._sent, self.id = context.broadcast(model), id(model)

    @property
    def value(self) -> Model:
        return self._sent.value


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(did, th, lang_pred, score, rate) per row; rate is the code length in bits a
    byte, null if the language is undetermined."""
    known = common.identified(docs)
    letters = known["text"].rlike(r"\p{L}")
    if model is None:
        return known.select("did", "th", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("rate"))
    shared = _Shared(docs.sparkSession.sparkContext, model)
    guessed = known.select("did", "th", letters.alias("letters"), "text").mapInArrow(_predicted(shared), "did long, th long, letters boolean, lang_pred string, score double, rate double")
    return guessed.select("did", "th", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"), F.when(F.col("letters"), F.col("rate")).alias("rate"))


def held_out(doc_id):
    """Whether a document is in the part that is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """(did, th, lang_pred, score, rate), learned from the documents not held out."""
    return predict(docs, train(docs.where(~held_out(docs["doc_id"])), per_language))


def rate_limits(docs: DataFrame, quantile: float = 0.995, per_language: int = 2000) -> dict[str, float]:
    """Bits a byte that so many documents of a language need at most; the highest of
    all where a language has too few to tell that quantile.  A model learned from one
    half of the documents not held out measures a sample of the other half,
    as texts that were learned from are cheaper than new ones."""
    known = docs.where(~held_out(docs["doc_id"]))
    half = F.floor(F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) / 4) % 2
    model = train(known.where(half == 0), per_language)
    if model is None:
        return {}
    shared = _Shared(docs.sparkSession.sparkContext, model)
    some = _sampled(known.where(half == 1), per_language)[0].where(F.col("text").cast("string").rlike(r"\p{L}"))
    rates = some.mapInArrow(_predicted(shared), "lang string, lang_pred string, score double, rate double")
    found: dict[str, list[float]] = {}
    for r in rates.where("lang = lang_pred").select("lang", "rate").collect():
        found.setdefault(r["lang"], []).append(r["rate"])
    limits = {x: float(np.quantile(v, quantile, method="higher")) for x, v in found.items()}
    highest = max(limits.values(), default=0.0)
    return {x: limits[x] if len(v) * (1 - quantile) >= 1 else highest for x, v in found.items()}


def in_known_language(docs: DataFrame, least_score: float = 0.5, per_language: int = 2000, quantile: float = 0.995) -> DataFrame:
    """The rows of ``docs`` less those whose language is undetermined, scores below
    ``least_score`` or takes more bits a byte than its ``rate_limits`` (of a language
    that has none, the highest of all); ``lang`` becomes the prediction. Columns of any
    other name stay as they are; it is one pass without an exchange."""
    limits = rate_limits(docs, quantile, per_language)
    limit = F.lit(max(limits.values(), default=float("inf")))
    for lang, most in sorted(limits.items()):
        limit = F.when(F.col("lang_pred") == lang, F.lit(most)).otherwise(limit)
    model = train(docs.where(~held_out(docs["doc_id"])), per_language)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    if model is None:
        return docs.where(F.lit(False))
    given = docs.select(row, common.text_of(docs).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    schema = T.StructType([given.schema["row"], *T.StructType.fromDDL("lang_pred string, score double, rate double")])
    found = given.mapInArrow(_predicted(_Shared(docs.sparkSession.sparkContext, model)), schema)
    found = found.where((F.col("score") >= least_score) & (F.col("rate") <= limit))
    return found.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")
