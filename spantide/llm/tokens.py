"""Token ids of whole texts, by a public byte-level BPE file, inside Arrow batches.

``Encoder.encode`` gives the ids that ``tokenizers`` gives for each text with special tokens
read as ordinary text, ``Encoder.encode_added`` those it gives as loaded, where the file's added
tokens that stand in a text are ids of their own. A text is first cut where the vocabulary's own split pattern always cuts,
whatever stands around: before a space or line feed that has a character other than white
space on both sides. Each distinct piece of a block is then encoded once and gathered by
numpy; recent pieces stay in a table of fixed size, so a worker's memory does not grow.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 20        # text gathered before a vectorised pass
CACHE_SLOTS = 1 << 20        # direct-mapped, by piece hash
CACHE_IDS = 1 << 23          # ids kept before the table starts afresh
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_ENCODERS: dict[str, "Encoder"] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("up", ())) < n + 1:
        inv = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, m in (("up", _MULT), ("down", inv)):
            a = np.full(n + 1, m, np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def prefix_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, down): ``(prefix[end] - prefix[start]) * down[start]`` names ``buf[start:end]``."""
    up, down = _powers(len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=prefix[1:])
    return prefix, down


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of ``buf[start:end]``, scrambled together with the length."""
    prefix, down = prefix_hashes(buf)
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


def split_points(buf: np.ndarray) -> np.ndarray:
    """Offsets of white space with other characters on both sides (see the module)."""
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    mid, before, after = buf[1:-1], buf[:-2], buf[2:]
    ok = ((mid == 32) | (mid == 10)) & (before > 32) & (before != 127) & (after > 32) & (after != 127)
    # bytes that may begin or end white space outside ASCII: C2 xx, E1 xx xx, E2 xx xx, E3 xx xx
    ok &= ~((after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3)))
    at = np.flatnonzero(ok) + 1
    wide = buf[at - 1] >= 0x80
    two, three = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    return at[~(wide & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))]


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks (token bytes to id) and special tokens of a byte-level BPE file of ``tokenizers``.

    The file writes each byte as one printable character: the printable ones of Latin-1
    as themselves, the others, in order, from U+0100 on. Ids follow the order of merges.
    """
    import json
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


class Encoder:
    """Merges run in ``tiktoken`` over the file's own ranks, which gives the ids of
    ``tokenizers`` (tested) at a fraction of the time."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        import re
        ranks, special = vocabulary(path)
        self.added = {token.encode(): i for token, i in special.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.mark = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if self.added else None
        self.bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.byte_len = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.byte_len[i] = len(token)
        self._clear()

    def _clear(self):
        self.key = np.zeros(CACHE_SLOTS, np.uint64)
        self.at = np.zeros(CACHE_SLOTS, np.int64)
        self.num = np.full(CACHE_SLOTS, -1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def _append(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint16)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encode_new(self, data: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray):
        """Append the ids of each span; those in ``plain`` begin with white space and end
        without, so they are encoded in one string and cut by their byte lengths."""
        at, num = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        p = np.flatnonzero(plain)
        if len(p):
            text = b"".join(data[s:e] for s, e in zip(starts[p].tolist(), ends[p].tolist()))
            ids = np.array(self.bpe.encode_ordinary(text.decode("utf-8")), np.uint16)
            ends_at = np.cumsum(self.byte_len[ids])
            cut = np.searchsorted(ends_at, np.cumsum(ends[p] - starts[p]), side="left") + 1
            num[p] = np.diff(cut, prepend=0)
            at[p] = self._append(ids) + cut - num[p]
        q = np.flatnonzero(~plain)
        if len(q):
            for i, s, e in zip(q.tolist(), starts[q].tolist(), ends[q].tolist()):
                ids = np.array(self.bpe.encode_ordinary(data[s:e].decode("utf-8")), np.uint16)
                at[i], num[i] = self._append(ids), len(ids)
        return at, num

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = b"".join(texts)
        if not data:
            return [np.zeros(0, np.uint16) for _ in texts]
        buf = np.frombuffer(data, np.uint8)
        doc_at = np.cumsum(sizes) - sizes
        inside = np.zeros(len(buf), bool)
        inside[split_points(buf)] = True
        mark = inside.copy()
        mark[doc_at[sizes > 0]] = True
        starts = np.flatnonzero(mark)
        ends = np.append(starts[1:], len(buf))
        h = span_hashes(buf, starts, ends)
        order = np.argsort(h)
        fresh = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
        first, uniq = order[fresh], h[order[fresh]]
        inv = np.empty(len(h), np.int64)
        inv[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(h))))
        if self.used > CACHE_IDS:
            self._clear()
        slot = (uniq & np.uint64(CACHE_SLOTS - 1)).astype(np.int64)
        at, num = self.at[slot].copy(), self.num[slot].copy()
        new = np.flatnonzero((self.key[slot] != uniq) | (num < 0))
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            lead = (buf[s] == 32) | (buf[s] == 10)
            plain = lead & inside[s] & (buf[e - 1] > 32) & (buf[e - 1] < 127)
            at[new], num[new] = self._encode_new(data, s, e, plain)
            self.key[slot[new]], self.at[slot[new]], self.num[slot[new]] = uniq[new], at[new], num[new]
        n = num[inv]
        total = np.cumsum(n)
        take = np.repeat(at[inv] - (total - n), n) + np.arange(total[-1])
        out = self.ids[take]
        bounds = np.concatenate([[0], total])[np.searchsorted(starts, np.append(doc_at, len(buf)))]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode_added(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, added tokens in it read as such: what stands between them is
        encoded on its own."""
        if not self.mark or not any(t in x for x in texts for t in self.added):
            return self.encode(texts)
        parts = [self.mark.split(x) for x in texts]              # added tokens at odd places
        plain = iter(self.encode([p for ps in parts for p in ps[::2]]))
        return [np.concatenate([np.array([self.added[p]], np.uint16) if k % 2 else next(plain) for k, p in enumerate(ps)])
                for ps in parts]


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pattern)
    return _ENCODERS[path]


def blocks_of(batches, text_col: str, block_bytes: int = BLOCK_BYTES):
    """Cut Arrow batches into slices of about ``block_bytes`` of text (a row at least)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(text_col).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // block_bytes
        at = np.flatnonzero(np.diff(block, prepend=-1) != 0)
        for a, b in zip(at.tolist(), np.append(at[1:], n).tolist()):
            yield batch.slice(a, b - a)


def text_bytes(batch, col: str) -> list[bytes]:
    """The texts of a batch in UTF-8; null is empty."""
    import pyarrow as pa
    return [t or b"" for t in batch.column(col).cast(pa.large_binary()).to_pylist()]
