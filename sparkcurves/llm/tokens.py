"""Token ids of whole texts by a public byte-level BPE vocabulary.

Byte-level BPE with this split pattern never joins characters across a single space or line feed that stands between two characters
which are not white space: it opens the next token. A batch of texts is cut there into pieces, and each distinct piece is encoded once
for the batch. Pieces are found by hash and then compared byte by byte. They are encoded by `tiktoken` with the ranks of the vocabulary
file, which gives the ids of the `tokenizers` library several times faster; texts with rarer characters go whole through `tokenizers` itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sparkcurves.llm import shared as S

VOCABULARY = "byte_bpe_50k.json"
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of byte-level BPE
BATCH_BYTES = 16_000_000
_GAP = np.zeros(256, bool)
_GAP[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True  # what either library's white space has among single bytes


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The 256 characters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. Strings of special tokens inside a text are ordinary text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        special = {token: i for token, i in vocabulary.items() if bytes(token, "utf-8") in ranks and i == len(vocabulary) - 1 and token[:2] == "<|"}
        for token in special:  # a special token's string is not made by merges
            ranks.pop(bytes(token, "utf-8"), None)
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that each id stands for
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets of each text's ids) of a string array without nulls. An empty text has no ids."""
        data, offsets = S.text_buffer(texts)
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for a, b in S.chunks_of(np.diff(offsets), BATCH_BYTES):
            own, n = self._batch(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(own)
            counts.append(n)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def _batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        gap, edge = _GAP[data], np.zeros(n + 1, bool)
        edge[offsets] = True
        cut = (data == 0x20) | (data == 0x0A)
        cut[1:] &= ~gap[:-1]
        cut[:-1] &= ~gap[1:] & ~edge[1:n]
        cut[-1] = False
        cut |= edge[:n]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        keys = S.span_hashes(data, starts, ends)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        lengths = ends - starts
        if not _same_bytes(data, starts, lengths, starts[first][which]):
            raise ValueError("two pieces share a hash")  # never seen; a wrong token is worse than a failed task
        ids, at = self._learn(data, starts[first], ends[first])
        sizes = np.diff(at)[which]
        owner = np.searchsorted(offsets, starts, "right") - 1
        counts = np.bincount(owner, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        out = ids[_ragged(at[:-1][which], sizes)]
        odd = np.unique(np.searchsorted(offsets, _odd(data), "right") - 1)
        if len(odd):
            parts, token_at = [], np.concatenate([[0], np.cumsum(counts)])
            previous = 0
            for i in odd.tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                parts += [out[token_at[previous] : token_at[i]], own]
                previous, counts[i] = i + 1, len(own)
            out = np.concatenate([*parts, out[token_at[previous] :]])
        return out, counts

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces: encoded as one text, whose tokens' known lengths in bytes tell the pieces apart."""
        alone = np.flatnonzero(_GAP[data[ends - 1]])  # a piece that ends in white space would reach into the next one
        loose = ~_GAP[data[starts]]  # a line feed, one token of its own, keeps a piece without one from its neighbour
        closed = np.ones(len(starts), bool)
        closed[alone] = False
        lengths, lead = (ends - starts)[closed], loose[closed].astype(np.int64)
        wanted = np.cumsum(lengths + lead)
        buffer = np.full(wanted[-1] if len(wanted) else 0, 0x0A, np.uint8)
        buffer[_ragged(wanted - lengths, lengths)] = data[_ragged(starts[closed], lengths)]
        joined = np.array(self.fast.encode_ordinary(buffer.tobytes().decode(errors="replace")), "<u4")
        reach = np.cumsum(self.sizes[joined])
        cuts = np.searchsorted(reach, wanted)
        if len(wanted) and not np.array_equal(reach[np.minimum(cuts, len(reach) - 1)], wanted):
            raise ValueError("a token crosses two pieces")
        stop = cuts + 1
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(wanted) else np.zeros(0, np.int64)
        begin = begin + lead
        begins, stops = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begins[closed], stops[closed] = begin, stop
        more, have = [joined], len(joined)
        for i in alone.tolist():
            text = data[starts[i] : ends[i]].tobytes().decode(errors="replace")
            own = np.array(self.fast.encode_ordinary(text), "<u4")
            more.append(own)
            begins[i], stops[i] = have, have + len(own)
            have += len(own)
        ids = np.concatenate(more)
        at = np.concatenate([[0], np.cumsum(stops - begins)])
        return ids[_ragged(begins, stops - begins)], at


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all items of runs given by start and size, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, models: np.ndarray, step: int = 200_000) -> bool:
    """Whether every span equals the span of the same length at its model. Spans cover the data without gaps."""
    for i in range(0, len(starts), step):
        own = slice(i, i + step)
        lo = starts[own][0]
        hi = starts[own][-1] + lengths[own][-1]
        if not np.array_equal(data[lo:hi], data[_ragged(models[own], lengths[own])]):
            return False
    return True


def _odd(data: np.ndarray) -> np.ndarray:
    """Places of characters beyond the settled alphabets, and of white space of several bytes."""
    high = np.flatnonzero(data >= 0xC2)
    lead = data[high]
    odd = lead >= 0xD5
    following = data[np.minimum(high + 1, len(data) - 1)]
    odd |= (lead == 0xC2) & ((following == 0x85) | (following == 0xA0))
    if odd.any():  # dashes, quotes, bullets and dots of general punctuation are settled too
        third = data[np.minimum(high + 2, len(data) - 1)]
        odd &= ~((lead == 0xE2) & (following == 0x80) & (third >= 0x90) & (third <= 0xA7))
    return high[odd]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
