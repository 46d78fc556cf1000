"""Token ids of whole texts by the tokenizers library, with each distinct part encoded once.

No token of these tokenizers runs from a character into white space after it, nor from a
letter into a full stop or comma, so a text may be cut there and the parts encoded alone.
Parts repeat heavily: a window of text is cut, its parts sorted and its ids put together
with NumPy. Ids of short parts are kept in a table of fixed size, so that Python only sees
those parts of a window that the table doesn't know.
"""

from __future__ import annotations

import json
import re

import numpy as np

from tenderlens.llm.common import claim_caches, keep_cache

CACHE_BYTES = 56 << 20  # of the table of short parts; half a quarter of it for each of two generations of long ones
ENTRY_BYTES = 220  # what a cached long part takes beside its characters and ids
HELD_IDS = 8  # a short part of more ids is encoded again in each window
WINDOW = 6 << 20  # bytes of text handled at a time
KEY_BYTES = 16  # longer parts are looked up one by one

# White space for the tokenizers, as UTF-8. The separators 1C to 1F count as such for Python only;
# nothing is cut after them either, whatever a tokenizer takes them for.
_BLANK = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20])
_NO_CUT_AFTER = np.isin(np.arange(256), [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x1C, 0x1D, 0x1E, 0x1F])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WIDE_BLANKS = re.compile("[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A blank, then plain characters but "<", or letters from C0 to FF.
_KEPT_SIZE = re.compile(rb" (?:[!-;=-~]|\xc3[\x80-\xbf])+")
_SAFE_CUT = re.compile(rb"[!-~](?=[ \n])")

_encoders: dict[bytes, "ChunkEncoder"] = {}
keep_cache("token ids", _encoders.clear)


def tokenizer_file(name: str) -> bytes:
    """The bytes of a public tokenizer; a few MB, so they may travel in a broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def cuts_of(raw: np.ndarray, text: str | None = None) -> np.ndarray:
    """Places (beyond 0) where UTF-8 bytes may be cut: at a blank after what is none, at a stop after a plain letter."""
    cut = _BLANK[raw[1:]] & ~_NO_CUT_AFTER[raw[:-1]]
    cut |= _STOP[raw[1:]] & _LETTER[raw[:-1]]
    if len(raw) and raw.max() > 127 and _WIDE_BLANKS.search(text if text is not None else raw.tobytes().decode("utf-8", "surrogatepass")):
        # The last byte of a wide blank may be that of a letter too; such places are just left out.
        before = np.flatnonzero(cut)
        ends = [c.encode()[-1] for c in "\u0085\u00a0\u1680\u2028\u2029\u202f\u205f\u3000"] + list(range(0x80, 0x8B))
        cut[before[np.isin(raw[before], ends)]] = False
    return np.flatnonzero(cut) + 1


def parts_of(text: str) -> list[str]:
    """Parts whose ids, one after the other, are the ids of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    cuts = [0, *cuts_of(np.frombuffer(raw, np.uint8), text).tolist(), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(cuts[:-1], cuts[1:])] if raw else []


def _windows(texts: list[str]):
    """(text number, bytes) of texts, those longer than a window cut where that is allowed."""
    for number, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        at = 0
        while len(raw) - at > WINDOW:
            cut = _SAFE_CUT.search(raw, at + WINDOW - 1)
            if not cut:
                break
            yield number, raw[at : cut.end()]
            at = cut.end()
        yield number, raw[at:]


def _groups(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(one part of each kind, kind of each part, hash and bytes and length of each kind) for parts of at most KEY_BYTES
    bytes, compared byte for byte."""
    if not len(starts):
        none = np.empty(0, np.uint64)
        return np.empty(0, np.int64), np.empty(0, np.int64), (none, none, none, np.empty(0, np.int64))
    padded = np.append(raw, np.zeros(KEY_BYTES, np.uint8))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 9,), (1,))
    low = eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]
    high = np.zeros(len(starts), np.uint64)
    long = np.flatnonzero(lengths > 8)
    high[long] = eight[starts[long] + 8] & _FIRST_BYTES[lengths[long] - 8]
    # No part is a prefix of another one with zero bytes behind it, as their lengths are in the key too.
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (lengths.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    for again in (False, True):
        m, a, b, c = (x[order] for x in (mixed, low, high, lengths))
        differs = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        if again or not (differs & (m[1:] == m[:-1])).any():
            break
        order = np.lexsort((lengths, high, low))  # two kinds share a hash
    first = np.flatnonzero(np.append(True, differs))
    kind = np.empty(len(starts), np.int64)
    kind[order] = np.cumsum(np.append(0, differs))
    return order[first], kind, (m[first], a[first], b[first], c[first])


class PartTable:
    """Ids of parts of at most KEY_BYTES bytes in arrays of fixed size. A part has two places, by its hash; where both
    are taken it replaces what stands in one of them, so the table only ever forgets."""

    def __init__(self, size: int):
        entry = 8 + 8 + 1 + 1 + 4 * HELD_IDS
        self.bits = max(size // entry, 2).bit_length() - 1
        places = 1 << self.bits
        self.low, self.high = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.length, self.count = np.zeros(places, np.uint8), np.zeros(places, np.uint8)
        self.ids = np.zeros((places, HELD_IDS), np.uint32)

    def _first(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, mixed: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the part stands there); no part is without bytes, so an empty place fits none."""
        at = self._first(mixed)
        fits = lambda p: (self.low[p] == low) & (self.high[p] == high) & (self.length[p] == length)
        known, other = fits(at), fits(at ^ 1)
        return np.where(other, at ^ 1, at), known | other

    def add(self, key: tuple[np.ndarray, ...], pool: np.ndarray, offset: np.ndarray, size: np.ndarray) -> None:
        mixed, low, high, length = key
        at = self._first(mixed)
        second = np.where(self.length[at] == 0, False, (self.length[at ^ 1] == 0) | (mixed & np.uint64(1)).astype(bool))
        at = np.where(second, at ^ 1, at)
        kept = np.flatnonzero(size <= HELD_IDS)
        places, one = np.unique(at[kept], return_index=True)
        kept = kept[one]
        self.low[places], self.high[places] = low[kept], high[kept]
        self.length[places], self.count[places] = length[kept], size[kept]
        inside = np.arange(HELD_IDS) < size[kept][:, None]
        self.ids[places] = np.where(inside, pool[np.where(inside, offset[kept][:, None] + np.arange(HELD_IDS), 0)], 0) if len(pool) else 0


def _in_pool(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, first one and number of ids of each part)."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    return np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, size


class ChunkEncoder:
    """``ids(texts)``: the little-endian unsigned 32-bit ids of each text, as bytes. ``encode_raw`` takes parts as
    UTF-8 and gives what ``_in_pool`` does; without it they are decoded one by one."""

    def __init__(self, encode_parts, encode_raw=None):
        self.encode_parts = encode_parts
        self.encode_raw = encode_raw or (lambda parts: _in_pool(self._plainly(parts)))
        self.table = PartTable(CACHE_BYTES)
        self.fresh: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _plainly(self, parts: list[bytes]) -> list[bytes]:
        return self.encode_parts([p.decode("utf-8", "surrogatepass") for p in parts])

    def look(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different long parts."""
        missing = set(parts).difference(self.fresh)
        known = {part: self.old[part] for part in missing.intersection(self.old)}
        missing = list(missing.difference(known))
        if missing:
            known.update(zip(missing, self._plainly(missing)))
        self.fresh.update(known)
        self.size += sum(map(len, known)) + sum(map(len, known.values())) + ENTRY_BYTES * len(known)
        found = list(map(self.fresh.__getitem__, parts))
        if self.size > CACHE_BYTES // 8:
            self.old, self.fresh, self.size = self.fresh, {}, 0
        return found

    def _short(self, joined: bytes, starts: np.ndarray, key: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first one and number of ids of each part) of different short parts."""
        at, known = self.table.find(*key)
        held, new = np.flatnonzero(known), np.flatnonzero(~known)
        pool = self.table.ids[at[held]].ravel()
        offset, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        offset[held], size[held] = np.arange(len(held)) * HELD_IDS, self.table.count[at[held]]
        if len(new):
            begin, end = starts[new].tolist(), (starts[new] + key[3][new]).tolist()
            made, first, n = self.encode_raw([joined[a:b] for a, b in zip(begin, end)])
            offset[new], size[new] = first + len(pool), n
            self.table.add(tuple(k[new] for k in key), made, first, n)
            pool = np.concatenate([pool, made])
        return pool, offset, size

    def ids(self, texts: list[str]) -> list[bytes]:
        found: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for number, raw in _windows(texts):
            if waiting and size + len(raw) > WINDOW:
                self._encode(waiting, found)
                waiting, size = [], 0
            if raw:
                waiting.append((number, raw))
                size += len(raw)
        if waiting:
            self._encode(waiting, found)
        return [f[0] if len(f) == 1 else b"".join(f) for f in found]

    def _encode(self, window: list[tuple[int, bytes]], found: list[list[bytes]]) -> None:
        joined = b"".join(raw for _, raw in window)
        raw = np.frombuffer(joined, np.uint8)
        edges = np.cumsum([len(r) for _, r in window])
        cuts = cuts_of(raw)
        starts = np.sort(np.concatenate([[0], cuts, edges[:-1]]))
        starts = starts[np.append(True, starts[1:] != starts[:-1])]
        lengths = np.diff(np.append(starts, len(raw)))
        short = lengths <= KEY_BYTES
        shorts = np.flatnonzero(short)
        one, kind, key = _groups(raw, starts[shorts], lengths[shorts])
        of = np.empty(len(starts), np.int64)
        of[shorts] = kind
        pool, offset, size = self._short(joined, starts[shorts[one]], key)
        longs = np.flatnonzero(~short).tolist()
        if longs:
            seen: dict[bytes, int] = {}
            for i in longs:
                of[i] = len(one) + seen.setdefault(joined[starts[i] : starts[i] + lengths[i]], len(seen))
            more, first, n = _in_pool(self.look(list(seen)))
            offset, size, pool = np.append(offset, first + len(pool)), np.append(size, n), np.append(pool, more)
        counts = size[of]
        ends = np.cumsum(counts)
        place = np.repeat(offset[of] - (ends - counts), counts)
        place += np.arange(ends[-1])
        out = pool[place].tobytes()
        # A window's text ends where its last part does.
        last = np.searchsorted(starts, edges) - 1
        upto = (ends[last] * 4).tolist()
        for (number, _), a, b in zip(window, [0, *upto[:-1]], upto):
            found[number].append(out[a:b])


def token_bytes(spec: bytes) -> np.ndarray | None:
    """UTF-8 bytes that each id stands for, or None for a tokenizer whose ids don't spell the text byte by byte,
    or that has an added token with a blank."""
    said = json.loads(spec)
    cut, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    plain = said.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
    if not plain or said["model"]["type"] != "BPE" or any(not t["content"].isascii() or " " in t["content"] for t in added):
        return None
    tokens = {**said["model"]["vocab"], **{t["content"]: t["id"] for t in added}}
    sizes = np.zeros(max(tokens.values()) + 1, np.int64)
    sizes[list(tokens.values())] = [len(t) for t in tokens]  # one character for each byte
    return sizes


def word_bytes(spec: bytes) -> np.ndarray | None:
    """UTF-8 bytes that each id stands for, for a tokenizer that drops blanks, lower-cases and marks the ends of words;
    None for others, or with an added token that has no "<". An added token stands for none here."""
    said = json.loads(spec)
    model, cut, added = said["model"], said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    mark = model.get("end_of_word_suffix") if model["type"] == "BPE" else None
    first, *more = cut.get("pretokenizers") or [{}]
    kinds = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    words = words and first["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    plain = [m.get("type") for m in more] == ["ByteLevel"] and not more[0].get("add_prefix_space") and not more[0].get("use_regex")
    if not mark or not words or not plain or kinds != ["NFC", "Replace", "Lowercase"] or any("<" not in t["content"] for t in added):
        return None
    names = {t["content"] for t in added}
    tokens = {t: i for t, i in model["vocab"].items() if t not in names}
    sizes = np.zeros(max([*tokens.values(), *(t["id"] for t in added)]) + 1, np.int64)
    sizes[list(tokens.values())] = [len(t.removesuffix(mark)) for t in tokens]
    return sizes if sizes[list(tokens.values())].all() else None


def library_encoder(spec: bytes) -> ChunkEncoder:
    """The encoder of a tokenizer file, one in each Python worker. Caches of other operators are dropped."""
    claim_caches("token ids")
    if spec not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()

        special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
        mark = special[-1] if special else None

        def each(parts: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]

        def encode_parts(parts: list[str]) -> list[bytes]:
            """Many parts to a string, with a special token between them: a call for each costs twice as much."""
            if mark is None:
                return each(parts)
            runs = [parts[i : i + 100] for i in range(0, len(parts), 100)]
            found = []
            for run, e in zip(runs, tokenizer.encode_batch_fast([mark.join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == tokenizer.token_to_id(mark)) * 4
                if len(cuts) != len(run) - 1:  # a part holds the mark itself
                    found += each(run)
                    continue
                raw, ends = ids.tobytes(), [*cuts.tolist(), len(ids) * 4]
                found += [raw[a:b] for a, b in zip([0, *(c + 4 for c in ends[:-1])], ends)]
            return found

        sizes, blank = token_bytes(spec), 0
        if sizes is None:
            sizes, blank = word_bytes(spec), 1

        def beside(part: bytes) -> bool:
            """Whether parts like this may stand side by side with nothing between them: from a blank to what is none;
            and where blanks are dropped, characters that keep their number of bytes when they are lower-cased."""
            if blank:
                return _KEPT_SIZE.fullmatch(part) is not None
            if part[0] != 32 or len(part) == 1:
                return False
            return 32 < part[-1] < 127 or (part[-1] > 127 and not part.decode("utf-8", "surrogatepass")[-1].isspace())

        def encode_raw(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """No token runs over the border of parts side by side, and the bytes of the ids say where each part ends."""
            pool, first, size = np.empty(0, np.uint32), np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
            plain = [] if sizes is None else [i for i, p in enumerate(parts) if beside(p)]
            alone = np.ones(len(parts), bool)
            if plain:
                runs = [b"".join([parts[i] for i in plain[j : j + 100]]).decode("utf-8", "surrogatepass") for j in range(0, len(plain), 100)]
                batch = tokenizer.encode_batch_fast(runs, add_special_tokens=False)
                ids = np.concatenate([np.array(e.ids, "<u4") for e in batch])
                ends, wanted = np.cumsum(sizes[ids]), np.cumsum([len(parts[i]) - blank for i in plain])
                at = np.searchsorted(ends, wanted)
                if ends[-1] == wanted[-1] and (ends[at] == wanted).all():
                    pool, n = ids, np.diff(at, prepend=-1)
                    first[plain], size[plain], alone[plain] = at + 1 - n, n, False
            rest = np.flatnonzero(alone).tolist()
            if rest:
                more, at, n = _in_pool(encode_parts([parts[i].decode("utf-8", "surrogatepass") for i in rest]))
                first[rest], size[rest], pool = at + len(pool), n, np.append(pool, more)
            return pool, first, size

        _encoders[spec] = ChunkEncoder(encode_parts, encode_raw)
    return _encoders[spec]


def in_slices(texts: list[str | None], characters: int = 6_000_000):
    """(first index, texts) in runs of about so many characters; null becomes empty."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > characters:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run
