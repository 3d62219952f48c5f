"""Toxicity scores of texts behind a noisy channel.

1. A character model: trigram counts over the folded characters of every document (case and accents folded, other marks one symbol), summed in
   tasks and then by code; their number is fixed by the alphabet.
2. Deobfuscation: a word is suspicious when it has digits or marks where letters belong, a letter three or more times in a row, or is a
   single letter in a row of single letters. Each suspicious span becomes a lattice: every character is kept, read as one of the letters it may
   stand for, or dropped as a separator or repetition, each at a price; a separator may also end a word, so a span can become several words. A Viterbi search under the character model picks the cheapest reading.
   All other words are their own reading.
3. The restored text is scored by its words and their first four and five letters: each such feature has a weight, the lower bound of its log odds
   in labelled texts, kept in a table of fixed size by hash. A word weighs what its features do together, and every distinct word of a text counts:
   its heaviest word, the sum of all others and that sum for the text's length are the inputs of a logistic regression. Language, source and id are
   never used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurves.llm import shared as S

BUCKETS = 1 << 20
TRAINING_ROWS = 60_000  # labelled rows that weights and regression are fit on, at most
PREFIXES = (4, 5)
INPUTS = 3  # of the regression
BOUND = 2.0  # standard deviations by which a feature's counts are moved against it

# --- folded characters ------------------------------------------------------------------------------------------------

SYMBOLS = 28  # 0 a gap between words, 1-26 letters, 27 anything else
_ACCENTED = {  # second bytes after 0xC3, lower and upper case alike
    "a": (0xA0, 0xA6), "c": (0xA7, 0xA7), "e": (0xA8, 0xAB), "i": (0xAC, 0xAF), "n": (0xB1, 0xB1), "o": (0xB2, 0xB6), "u": (0xB9, 0xBC), "y": (0xBD, 0xBF),
}
_SECOND = np.full(256, 27, np.uint8)
for _letter, (_low, _high) in _ACCENTED.items():
    _SECOND[_low : _high + 1] = ord(_letter) - 96
    _SECOND[_low - 32 : _high - 31] = ord(_letter) - 96
_SECOND[[0x9F]] = ord("s") - 96
_FIRST = np.full(256, 27, np.uint8)
_FIRST[[0x20, *range(0x09, 0x0E)]] = 0
_FIRST[65:91] = np.arange(1, 27)
_FIRST[97:123] = np.arange(1, 27)


def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each character, place of its first byte); continuation bytes have no symbol of their own."""
    symbols = _FIRST[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    symbols[lead] = _SECOND[data[lead + 1]]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    return symbols[at], at


@dataclass
class CharacterModel:
    """-log p(symbol | two symbols before)."""

    cost: np.ndarray = field(default_factory=lambda: np.zeros((SYMBOLS, SYMBOLS, SYMBOLS)))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two = three.sum(axis=0)
        one = (two.sum(axis=0) + 1) / (two.sum() + SYMBOLS)
        back = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
        return cls(-np.log((three + 20 * back[None]) / (three.sum(axis=2, keepdims=True) + 20)))


def character_counts(documents: DataFrame) -> np.ndarray:
    """Trigrams of folded characters over all rows; SYMBOLS ** 3 numbers come back."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = S.text_buffer(batch.column("text"))
            for a, b in S.chunks_of(np.diff(offsets), 1 << 20):
                symbols = fold(data[offsets[a] : offsets[b]])[0].astype(np.int64)
                if len(symbols):  # texts follow each other; the few trigrams across their ends don't matter to the model
                    symbols = np.concatenate([[0, 0], symbols, [0]])
                    total += np.bincount(symbols[:-2] * SYMBOLS**2 + symbols[1:-1] * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.record_batch({"code": pa.array(found), "n": pa.array(total[found])})

    rows = S.map_arrow(documents.select(S.whole_text("text").alias("text")), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for row in rows:
        out[row["code"]] = row["n"]
    return out


# --- the lattice ------------------------------------------------------------------------------------------------------

STANDS_FOR = {  # marks and digits that are read as letters
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~'`^,:;/\\"
READ, DROP_SEPARATOR, DROP_DOUBLE, DROP_REPEAT, DROP_MARK, KEEP_OTHER = 0.5, 0.2, 4.0, 0.2, 9.0, 6.0
DROP_OPENING = 3.0  # "¡" is a letter in hiding or opens a sentence


def decode(span: str, model: CharacterModel) -> str:
    """The most likely words behind a span: exact Viterbi over its character lattice, the last two symbols being the state.

    A separator is dropped or read as the gap after a word, at the price the character model gives to a word's end and the next one's start. No
    state is dropped; there are at most SYMBOLS ** 2. A state points back to the one before it, so time and memory grow with the span's length.
    """
    cost = model.cost.tolist()
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # price, reading as linked characters
    run, previous = 0, ""
    for ch in _folded(span):
        if ch not in SEPARATORS:  # how often in a row the character has come; two may be the word's own, three are drawn out
            run, previous = (run + 1 if ch == previous else 1), ch
        letter_itself = "a" <= ch <= "z"
        readings = [(ch, ord(ch) - 96, 0.0)] if letter_itself else [(x, ord(x) - 96, READ) for x in STANDS_FOR.get(ch, "")]
        offers = []
        for state, (price, reading) in states.items():
            a, b = state
            row = cost[a][b]
            for letter, s, extra in readings:
                offers.append(((b, s), price + extra + row[s], reading, letter))
                if s == b:
                    offers.append((state, price + (DROP_REPEAT if run > 2 else DROP_DOUBLE), reading, ""))
            if ch in SEPARATORS:
                offers.append((state, price + DROP_SEPARATOR, reading, ""))
                if b:
                    offers.append(((0, 0), price + row[0], reading, " "))
            elif not readings:
                offers.append(((b, 27), price + KEEP_OTHER + row[27], reading, ch))
                offers.append((state, price + DROP_MARK, reading, ""))
            elif not letter_itself:
                offers.append((state, price + (DROP_OPENING if ch == "¡" and not b else DROP_MARK), reading, ""))
        best: dict[tuple[int, int], tuple] = {}
        for offer in offers:
            if offer[0] not in best or offer[1] < best[offer[0]][1]:
                best[offer[0]] = offer
        states = {state: (price, (reading, added) if added else reading) for state, price, reading, added in best.values()}
    node = min(((price + (cost[a][b][0] if b or node is None else 0.0), a, b, node) for (a, b), (price, node) in states.items()), key=lambda x: x[:3])[3]
    out = []
    while node:
        node, added = node
        out.append(added)
    return "".join(reversed(out)).rstrip()


def _folded(span: str) -> str:
    out = []
    for ch in span:
        raw = ch.encode("utf-8", "replace")
        if len(raw) == 2 and raw[0] == 0xC3 and 0 < _SECOND[raw[1]] < 27:
            out.append(chr(96 + _SECOND[raw[1]]))
        else:
            out.append(ch.lower() if ch.isascii() else ch)
    return "".join(out)


_TRIM = re.compile(r"^[\"'(\[{<«“‘]+|[.,;:?…\"')\]}>»”’]+$")
_TAIL = re.compile(r"([^\w\s])\1+$")
_SKIP = re.compile(r"^\d[\d.,:%€$/-]*[a-zA-Z]{0,2}$|=|://|@.*\.|^[A-Z0-9]{16,}$|[0-9a-f]{16,}")


def readable(word: str, model: CharacterModel, known: dict[str, str]) -> str:
    """A suspicious word as it is to be read; numbers, addresses and keys stay as they are."""
    got = known.get(word)
    if got is None:
        core = _TAIL.sub("", _TRIM.sub("", word))
        got = word if _SKIP.search(core) else (core if core.isalpha() and not re.search(r"(.)\1\1", core) else decode(core, model))
        if len(known) < 200_000:
            known[word] = got
    return got


_MARKS = sorted((set(STANDS_FOR) | set(SEPARATORS) | set("0123456789")) - {" "})
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[ord(c) for c in _MARKS if c.isascii()]] = True
_ENDINGS = [c for c in STANDS_FOR if c in "$€£"]  # marks that are read as letters at a word's end
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC4)]] = True


def _places(data: np.ndarray, mark: str) -> np.ndarray:
    """Where a character begins in a stretch of bytes."""
    raw = mark.encode()
    found = np.flatnonzero(data[: len(data) - len(raw) + 1] == raw[0]) if len(data) >= len(raw) else np.zeros(0, np.int64)
    for i, byte in enumerate(raw[1:], 1):
        found = found[data[found + i] == byte]
    return found


def restored_words(data: np.ndarray, model: CharacterModel, known: dict[str, str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
    """(word starts, word ends, readings) of one stretch of bytes; readings are (first word, last word, text), in order."""
    lowered = S._LOWER[data]
    inside = ~S._SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return starts, ends, []
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    suspect = _SUSPECT[data]
    for mark in _MARKS:
        if not mark.isascii():
            suspect[_places(data, mark)] = True
    letters, marks, characters = count(_LETTER[data]), count(suspect), count((data & 0xC0) != 0x80)
    triple = np.zeros(len(data), bool)
    triple[2:] = (lowered[2:] == lowered[1:-1]) & (lowered[1:-1] == lowered[:-2]) & _LETTER[data[2:]]
    triples = count(triple)
    # marks count only between the first and the last letter of a word, or right before it
    tail = np.where(_LETTER[data], np.arange(len(data)), -1)
    last_letter = np.maximum.reduceat(tail, starts)
    has = letters[ends] - letters[starts] > 0
    inner = np.where(has, marks[np.maximum(last_letter, starts)] - marks[starts], 0)
    closing = (data >= 48) & (data < 58)
    for mark in _ENDINGS:
        closing[_places(data, mark) + len(mark.encode()) - 1] = True
    ending = np.where(has & (ends - 1 > last_letter), closing[ends - 1], False)
    odd = has & ((inner > 0) | ending | (triples[ends] - triples[starts] > 0))
    single = (characters[ends] - characters[starts] == 1) & (_LETTER[data[starts]] | suspect[starts])
    readings: list[tuple[int, int, str]] = []
    raw = data.tobytes()
    run = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    spaced = [(a, b - 1) for a, b in zip(run[::2].tolist(), run[1::2].tolist(), strict=True) if b - a >= 3]
    in_run = np.zeros(len(starts), bool)
    for a, b in spaced:
        in_run[a : b + 1] = True
        readings.append((a, b, readable(raw[starts[a] : ends[b]].decode(errors="replace"), model, known)))
    for i in np.flatnonzero(odd & ~in_run).tolist():
        word = raw[starts[i] : ends[i]].decode(errors="replace")
        text = readable(word, model, known)
        if text != word:
            readings.append((i, i, text))
    return starts, ends, sorted(readings)


def restore(text: str, model: CharacterModel) -> str:
    """The text with its suspicious words read; other words as they are, with single spaces."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return ""
    starts, ends, readings = restored_words(data, model, {})
    words = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(starts, ends, strict=True)]
    for a, b, reading in reversed(readings):
        words[a : b + 1] = [reading]
    return " ".join(words)


# --- features ---------------------------------------------------------------------------------------------------------

_EDGE = np.ones(256, bool)
_EDGE[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = False


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    """(words, 1 + prefixes) buckets: the lower-cased word without marks around it, and its first bytes."""
    data = S._LOWER[data]
    body = ~_EDGE[data]
    place = np.arange(len(data))
    first = np.minimum.reduceat(np.where(body, place, len(data)), starts) if len(starts) else starts
    last = np.maximum.reduceat(np.where(body, place, -1), starts) if len(starts) else starts
    bare = (last < first) | (first >= ends)
    first, last = np.where(bare, starts, first), np.where(bare, ends - 1, last)
    stop = last + 1
    out = [S.span_hashes(data, first, stop)]
    for n in PREFIXES:
        short = np.minimum(first + n, stop)
        out.append(S.mix(S.span_hashes(data, first, short) + np.uint64(n)) if len(first) else np.zeros(0, np.uint64))
    return (np.stack(out, axis=1) % np.uint64(buckets)).astype(np.int64) if len(first) else np.zeros((0, 1 + len(PREFIXES)), np.int64)


def text_features(texts: pa.Array, model: CharacterModel, known: dict[str, str], buckets: int) -> Iterator[np.ndarray]:
    """(words, features of a word) buckets of each restored text, text by text."""
    data, offsets = S.text_buffer(texts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = data[a:b]
        if a == b:
            yield np.zeros((0, 1 + len(PREFIXES)), np.int64)
            continue
        starts, ends, readings = restored_words(own, model, known)
        features = _features(own, starts, ends, buckets) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)
        if readings:
            keep = np.ones(len(starts), bool)
            for first, last, _ in readings:
                keep[first : last + 1] = False
            more = np.frombuffer(" ".join(r[2] for r in readings).encode(), np.uint8)
            inside = ~S._SPACE[more]
            begin, stop = inside.copy(), inside.copy()
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            begins, stops = np.flatnonzero(begin), np.flatnonzero(stop) + 1
            features = np.vstack([features[keep], _features(more, begins, stops, buckets)]) if len(begins) else features[keep]
        yield features


@dataclass
class Scorer:
    model: CharacterModel
    weights: np.ndarray  # by bucket
    slopes: np.ndarray  # by input
    intercept: float

    def evidence(self, texts: pa.Array, known: dict[str, str]) -> np.ndarray:
        """(texts, INPUTS): the heaviest distinct word, the sum of the others, and that sum over the root of the number of distinct words."""
        out = np.zeros((len(texts), INPUTS))
        for i, features in enumerate(text_features(texts, self.model, known, len(self.weights))):
            if not len(features):
                continue
            own = self.weights[features].sum(axis=1)
            if not own.any():
                continue
            _, first = np.unique(features[:, 0], return_index=True)
            own = own[first]
            rest = own.sum() - own.max()
            out[i] = own.max(), rest, rest / np.sqrt(len(own))
        return out

    def scores(self, texts: pa.Array, known: dict[str, str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts, known) @ self.slopes + self.intercept, -500, 500)))


def training_rows(labels: DataFrame, held_out: int = 5, most: int = TRAINING_ROWS) -> DataFrame:
    """labels(doc_id, toxic) -> label_id, toxic of at most `most` rows in the order of a hash; crc32(doc_id as text) % held_out is not 0 in them.

    Rows with a null id or label are left out; of several labels for an id the larger one counts.
    """
    rows = S.pick(labels, label_id="doc_id", toxic="toxic").where("label_id is not null and toxic in (0, 1)")
    rows = rows.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % held_out != 0)
    rows = rows.groupBy("label_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRAINING_ROWS) -> Scorer:
    """Character model from all documents(doc_id, text); weights and regression from the training rows of labels(doc_id, toxic)."""
    model = CharacterModel.from_counts(character_counts(documents))
    train = documents.join(F.broadcast(training_rows(labels, most=most)), documents["doc_id"] == F.col("label_id"))  # at most `most` ids
    train = S.store(train.select(S.whole_text("text").alias("text"), "toxic"), "toxic-training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, rows = {}, np.zeros((2, buckets), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            kinds = batch.column("toxic").to_numpy()
            for kind, features in zip(kinds, text_features(batch.column("text"), model, known, buckets), strict=True):
                total[kind, np.unique(features)] += 1
                rows[kind] += 1
        found = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch({"bucket": pa.array(np.append(found, -1)), "clean": pa.array(np.append(total[0, found], rows[0]).astype(np.int64)),
                               "bad": pa.array(np.append(total[1, found], rows[1]).astype(np.int64))})

    table = S.store(S.map_arrow(train, count, "bucket long, clean long, bad long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("bad").alias("bad")), "toxic-counts")
    whole = table.where("bucket = -1").first()
    n_clean, n_bad = (int(whole["clean"]), int(whole["bad"])) if whole else (0, 0)
    weights = np.zeros(buckets)
    # at most one row a bucket, and of them only features that lean to the toxic side
    for row in table.where((F.col("bucket") >= 0) & (F.col("bad") > BOUND**2) & (F.col("bad") * max(n_clean, 1) > F.col("clean") * max(n_bad, 1))).collect():
        low = row["bad"] - BOUND * np.sqrt(row["bad"])
        high = row["clean"] + BOUND * np.sqrt(row["clean"]) + 1
        weights[row["bucket"]] = max(0.0, np.log(low / (n_bad + 1)) - np.log(high / (n_clean + 1)))
    scorer = Scorer(model, weights, np.ones(INPUTS), 0.0)

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scorer.evidence(batch.column("text"), {})
        return pa.record_batch({"toxic": batch.column("toxic"), **{f"x{i}": pa.array(found[:, i]) for i in range(INPUTS)}})

    inputs = [f"x{i}" for i in range(INPUTS)]
    points = S.map_arrow(train, S.arrow_map(weigh), "toxic int, " + ", ".join(f"{x} double" for x in inputs)).groupBy(
        *[F.round(x, 2).alias(x) for x in inputs]).agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).orderBy(*inputs).collect()  # at most `most` rows
    scorer.slopes, scorer.intercept = _logistic([(*(r[x] for x in inputs), r["n"], r["bad"]) for r in points])
    return scorer


def _logistic(points: list[tuple], ridge: float = 0.05, steps: int = 50) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton's method; a small ridge keeps them finite where evidence parts the labels without error."""
    if not points or not sum(p[-1] for p in points):
        return np.ones(INPUTS), -5.0
    table = np.array(points, float)
    x, n, bad = table[:, :-2], table[:, -2], table[:, -1]
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (bad - n * p) - ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = TRAINING_ROWS) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted, one row per row.

    `held_out` rows have crc32(doc_id as text) % 5 = 0 (a null id counts as the text ''); no label of theirs is used. Null and empty texts get
    the score of a text without evidence. Rows that repeat have equal scores. Without toxic training rows all scores are low. An empty table
    gives an empty result; other columns are ignored. Whole texts are read, however long.
    """
    texts = S.pick(documents, doc_id="doc_id", text="text")
    scorer = fit(texts, labels, buckets, most)
    place = np.flatnonzero(scorer.weights)
    sparse, slopes, intercept, model = scorer.weights[place], scorer.slopes, scorer.intercept, scorer.model
    rows = texts.select("doc_id", S.whole_text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(buckets)
        weights[place] = sparse
        own, known = Scorer(model, weights, slopes, intercept), {}
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(own.scores(batch.column("text"), known))})

    scored = S.map_arrow(rows, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")
    fold_ = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return scored.select("doc_id", (fold_ == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
