"""Alignments: arrays of edit operations between a reference's and a hypothesis's tokens.

`edit_script` is the plain Levenshtein script; `compound_align` may split a hypothesis token over several reference
tokens. Both run over Arrow batches; everything that reads an alignment is a built-in expression.

Ties in the edit script: common ends are matched first; then, from the end back, a deletion is preferred to an
insertion and that to a diagonal step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequences import SPACES, let
from .distance import columns, distance, ends, masks

MATCH, INSERT, DELETE, SUBSTITUTE = "MATCH", "INSERT", "DELETE", "SUBSTITUTE"
OP_TYPES = {MATCH: 0, INSERT: 1, DELETE: 2, SUBSTITUTE: 3}
OP_FIELDS = "type:string,ref:string,hyp:string,ref_idx:int,hyp_idx:int,ref_start:int,ref_end:int,hyp_start:int,hyp_end:int,hyp_lp:boolean,hyp_rp:boolean,ref_lp:boolean,ref_rp:boolean"
OPS = f"array<struct<{OP_FIELDS}>>"
_OP_ARROW = pa.list_(
    pa.struct(
        [("type", pa.string()), ("ref", pa.string()), ("hyp", pa.string())]
        + [(x, pa.int32()) for x in ("ref_idx", "hyp_idx", "ref_start", "ref_end", "hyp_start", "hyp_end")]
        + [(x, pa.bool_()) for x in ("hyp_lp", "hyp_rp", "ref_lp", "ref_rp")]
    )
)
#: How unlike the reference tokens that it is split over a hypothesis token may be.
MOST_UNLIKE = 0.34
#: How many cells tables that are made at once have, and how many pairs.
CELLS, TOGETHER = 1 << 20, 1024
#: How many tokens a pair has at most whose script is remembered, and how many such scripts a process remembers.
FEW, REMEMBERED = 16, 1 << 14
_SEEN: dict[tuple[tuple[str, ...], tuple[str, ...]], list] = {}
#: How many rows are aligned at once.
ROWS = 256
#: Every how many columns of a table are kept.
KEPT = 1024


def script(ref: Sequence[Hashable], hyp: Sequence[Hashable]) -> tuple[list[int], list[int], list[int]]:
    """(type, ref index, hyp index) of each step of the edit script, in order, as three lists; the index of a missing
    side is where it would be.

    All that the walk back needs is two bits a cell. Columns are kept at every `KEPT`-th token and computed again block
    by block, so two texts of n and m tokens take n * (m / KEPT + KEPT) bits.
    """
    n, m = len(ref), len(hyp)
    head, tail = ends(ref, hyp)
    r, h = ref[head : n - tail], hyp[head : m - tail]
    i, j = len(r), len(h)
    kinds, at_ref, at_hyp = [], [], []
    if i and j:
        found, start = masks(r), ((1 << i) - 1, 0)
        kept = [start]
        for k, (up, down, _) in enumerate(columns(found, i, h, *start), 1):
            if k % KEPT == 0:
                kept.append((up, down))
        rows = i
        for block in range((j - 1) // KEPT, -1, -1):
            low = block * KEPT
            bits = [kept[block], *((up, down) for up, down, _ in columns(found, rows, h[low : low + KEPT], *kept[block]))]
            while i and j > low:
                if bits[j - low][0] >> (i - 1) & 1:
                    i -= 1
                    kind = 2
                else:
                    j -= 1
                    if j and bits[j - low][1] >> (i - 1) & 1:
                        kind = 1
                    else:
                        i -= 1
                        kind = 0 if r[i] == h[j] else 3
                kinds.append(kind)
                at_ref.append(head + i)
                at_hyp.append(head + j)
    while i:
        i -= 1
        kinds.append(2)
        at_ref.append(head + i)
        at_hyp.append(head + j)
    while j:
        j -= 1
        kinds.append(1)
        at_ref.append(head + i)
        at_hyp.append(head + j)
    both = list(range(head))
    return (
        [0] * head + kinds[::-1] + [0] * tail,
        both + at_ref[::-1] + list(range(n - tail, n)),
        both + at_hyp[::-1] + list(range(m - tail, m)),
    )


class _Side:
    """One side's tokens of a batch as flat columns; a step takes its token by number, -1 for none."""

    def __init__(self, tokens: pa.Array, field: str) -> None:
        flat = tokens.flatten()
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.text, self.idx, self.first, self.last = (flat.field(x) for x in (field, "idx", "start", "end"))

    def taken(self, at: np.ndarray) -> dict[str, pa.Array]:
        at = pa.array(at, mask=at < 0)
        return {"": self.text.take(at), "_idx": self.idx.take(at), "_start": self.first.take(at), "_end": self.last.take(at)}


def edit_script(ref: Column, hyp: Column, normalized: bool = True) -> Column:
    """The edit script of two token arrays, as OPS."""
    from pyspark.sql.pandas.functions import arrow_udf

    field = "norm" if normalized else "raw"
    names = pa.array(list(OP_TYPES))

    def some(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = _Side(a, field), _Side(b, field)
        codes = pa.chunked_array([left.text.cast(pa.string()), right.text.cast(pa.string())]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).tolist()
        there = (a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)).tolist()
        shift = len(left.text)
        kinds, at_ref, at_hyp, sizes = [], [], [], [0]
        for valid_, s, e, t, f in zip(there, left.starts.tolist(), left.ends.tolist(), right.starts.tolist(), right.ends.tolist(), strict=True):
            k, i, j = script(codes[s:e], codes[shift + t : shift + f]) if valid_ else ([], [], [])
            kinds.append(np.array(k, np.int8))
            at_ref.append(np.array(i, np.int64) + s)
            at_hyp.append(np.array(j, np.int64) + t)
            sizes.append(sizes[-1] + len(k))
        kind, i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kinds, at_ref, at_hyp))
        no = pa.array(np.zeros(len(kind), bool))
        made = {f"ref{k}": v for k, v in left.taken(np.where(kind == OP_TYPES[INSERT], -1, i)).items()} | {f"hyp{k}": v for k, v in right.taken(np.where(kind == OP_TYPES[DELETE], -1, j)).items()}
        made |= {"type": names.take(pa.array(kind)), "hyp_lp": no, "hyp_rp": no, "ref_lp": no, "ref_rp": no}
        flat = pa.StructArray.from_arrays([made[f.name].cast(f.type) for f in _OP_ARROW.value_type], fields=list(_OP_ARROW.value_type))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32(), mask=np.array([*(not x for x in there), False])), flat)

    @arrow_udf(OPS)
    def ops(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(a[k : k + ROWS], b[k : k + ROWS]) for k in range(0, max(1, len(a)), ROWS)])

    return ops(ref, hyp)


def _boundaries(parts: list[str], whole: str) -> list[int]:
    """Where `whole` is cut so that its pieces align with `parts`."""
    column = [0] * (sum(map(len, parts)) + 1)
    for kind, i, j in reversed(list(zip(*script("".join(parts), whole), strict=True))):
        column[i + (kind != 1)] = max(column[i + (kind != 1)], j + (kind != 2))
    cuts, done = [], 0
    for p in parts[:-1]:
        done += len(p)
        cuts.append(max(column[: done + 1]))
    return cuts


def plain(text: str) -> str:
    """The aligner's own normalization: lower case, letters without their marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


Script = list[tuple[str, int | None, int | None, int, int, bool, bool]]


def compound_script(ref: list[str], hyp: list[str]) -> Script:
    """(type, ref index, hyp index, first and last character of the hyp token, left partial, right partial).

    A word-level alignment whose substitutions cost by how unlike the words are, from 1/2 to 1, with one more step:
    a hyp token against two or more reference tokens that it is like when they are joined; how many is a matter of their
    lengths alone.
    """
    return compound_scripts([(ref, hyp)])[0]


def compound_scripts(pairs: list[tuple[list[str], list[str]]]) -> list[Script]:
    """The same for many pairs: equal ones once, and the tables of those of like size row by row at once."""
    found: dict[tuple[tuple[str, ...], tuple[str, ...]], Script] = {}
    keys = [(tuple(r), tuple(h)) for r, h in pairs]
    todo = sorted((_Task(*k) for k in dict.fromkeys(keys) if k not in _SEEN), key=lambda t: (len(t.h), len(t.r)))
    found.update((k, _SEEN[k]) for k in keys if k in _SEEN)
    at = 0
    while at < len(todo):
        rows, end = 0, at
        while end < len(todo) and end - at < TOGETHER:
            rows = max(rows, len(todo[end].r) + 1)
            if end > at and rows * (len(todo[end].h) + 1) * (end - at + 1) > CELLS:
                break
            end += 1
        group = todo[at:end]
        for t, steps in zip(group, _tables(group), strict=True):
            found[t.ref, t.hyp] = t.walked(steps)
        at = end
    for t in todo:
        if len(t.ref) + len(t.hyp) <= FEW:
            if len(_SEEN) >= REMEMBERED:
                _SEEN.clear()
            _SEEN[t.ref, t.hyp] = found[t.ref, t.hyp]
    return [found[k] for k in keys]


class _Task:
    """A pair of token sequences and what the part between its common ends costs."""

    def __init__(self, ref: tuple[str, ...], hyp: tuple[str, ...]) -> None:
        self.ref, self.hyp = ref, hyp
        # Where both are long, only the part between common ends needs the table, and what a compound may reach from there.
        self.longest = max(map(len, hyp), default=0)
        reach = int(self.longest / (1 - MOST_UNLIKE)) + 1
        head, tail = ends(ref, hyp)
        self.head, self.tail = max(0, head - reach), max(0, tail - reach)
        self.r, self.h = ref[self.head : len(ref) - self.tail], hyp[self.head : len(hyp) - self.tail]

    def prices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """What each different r token costs for each different h token, which of them each r and h token is, and as four
        columns all compounds: how many r tokens end before which, the h token, and how unlike they are."""
        r, h = self.r, self.h
        mine = {x: k for k, x in enumerate(dict.fromkeys(r))}
        # The longest first, so that all that a step still has to look at are the first ones.
        theirs = {x: k for k, x in enumerate(sorted(dict.fromkeys(h), key=len, reverse=True))}
        which_r, which_h = np.array([mine[x] for x in r], np.int64), np.array([theirs[x] for x in h], np.int64)
        sizes, lengths = np.array([len(x) for x in mine], np.int64), np.array([len(x) for x in theirs], np.int64)
        if not r or not h:
            return np.empty((len(mine), len(theirs))), which_r, which_h, [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        patterns = _Patterns(list(theirs), lengths)
        far = patterns.distances(list(mine), sizes)
        cost = 0.5 + 0.5 * (far / np.maximum(np.maximum(sizes[:, None], lengths[None, :]), 1))
        for x, k in mine.items():
            if x in theirs:
                cost[k, theirs[x]] = 0.0
        stops, parts, token, unlike = patterns.joined(r, self.longest)
        # Every place of a compound's h token.
        order = np.argsort(which_h, kind="stable")
        times = np.bincount(which_h, minlength=len(theirs))
        first = np.cumsum(times) - times
        n = times[token]
        each = np.repeat(np.arange(len(token)), n)
        place = order[first[token[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        return cost, which_r, which_h, [stops[each], parts[each], place, unlike[each]]

    def walked(self, steps: np.ndarray) -> Script:
        """The script, by the walk back through the table of steps."""
        ref, hyp, head, tail, r, h = self.ref, self.hyp, self.head, self.tail, self.r, self.h
        n, m = len(ref), len(hyp)
        out = [(MATCH, n - 1 - k, m - 1 - k, 0, len(hyp[m - 1 - k]), False, False) for k in range(tail)]
        i, j = len(r), len(h)
        while i or j:
            step = steps.item(i, j) if i else 1
            if step == 0:
                i -= 1
                out.append((DELETE, head + i, None, 0, 0, False, False))
            elif step == 1:
                j -= 1
                out.append((INSERT, None, head + j, 0, len(h[j]), False, False))
            elif step == 2:
                i, j = i - 1, j - 1
                out.append((MATCH if r[i] == h[j] else SUBSTITUTE, head + i, head + j, 0, len(h[j]), False, False))
            else:
                k = step - 1
                j -= 1
                parts, whole = r[i - k : i], h[j]
                cuts = [0, *_boundaries(list(parts), whole), len(whole)]
                for p in range(k - 1, -1, -1):
                    a, b = cuts[p], cuts[p + 1]
                    kind = DELETE if a == b else MATCH if whole[a:b] == parts[p] else SUBSTITUTE
                    out.append((kind, head + i - k + p, None if a == b else head + j, a, b, a > 0 and a < b, b < len(whole) and a < b))
                i -= k
        out += [(MATCH, k, k, 0, len(hyp[k]), False, False) for k in range(head - 1, -1, -1)]
        return out[::-1]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Patterns:
    """Different tokens, the longest first, whose distances from many texts are taken at once: the kernel of `columns` with
    a machine word a token, a character of all texts at a time. Tokens of more than 64 characters are taken alone."""

    def __init__(self, tokens: list[str], lengths: np.ndarray) -> None:
        self.tokens, self.lengths = tokens, lengths
        self.long = int((lengths > 64).sum())
        short = lengths[self.long :]
        points = _points("".join(tokens[self.long :]))
        self.letters, letter = np.unique(points, return_inverse=True)
        #: By letter and token the bits of its places; the last row is that of letters that no token has.
        self.word = np.uint32 if short.max(initial=0) <= 32 else np.uint64
        self.found = np.zeros((len(self.letters) + 1, len(short)), self.word)
        place = np.arange(len(points)) - np.repeat(np.cumsum(short) - short, short)
        np.bitwise_or.at(self.found, (letter, np.repeat(np.arange(len(short)), short)), np.left_shift(self.word(1), place.astype(self.word)))
        self.full = np.array([(1 << n) - 1 for n in short.tolist()], self.word)
        #: How many texts are read at once.
        self.block = max(1, CELLS // 16 // max(1, len(short)))

    def coded(self, text: str) -> np.ndarray:
        points = _points(text)
        at = np.searchsorted(self.letters, points)
        return np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == points, at, len(self.letters)) if len(self.letters) else np.zeros(len(points), np.int64)

    def _start(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        return np.full((rows, len(self.full)), ~self.word(0)), np.zeros((rows, len(self.full)), self.word)

    def _step(self, letters: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
        """One more letter of each row's text, in place."""
        same = self.found[letters, : up.shape[1]]
        across = same & up
        across += up
        across ^= up
        across |= same
        same |= down
        more = across | up
        np.invert(more, out=more)
        more |= down
        across &= up
        more <<= self.word(1)
        more |= self.word(1)
        across <<= self.word(1)
        np.bitwise_or(same, more, out=up)
        np.invert(up, out=up)
        up |= across
        np.bitwise_and(more, same, out=down)

    def _far(self, size: np.ndarray | int, up: np.ndarray, down: np.ndarray, tokens: slice = slice(None)) -> np.ndarray:
        """The distances of texts of some sizes, from the last column's steps."""
        full = self.full[tokens]
        return size + np.bitwise_count(up & full).astype(np.int32) - np.bitwise_count(down & full)

    def distances(self, texts: list[str], sizes: np.ndarray) -> np.ndarray:
        """The distance of each text from each token."""
        out = np.zeros((len(texts), len(self.tokens)), np.int32)
        for b in range(self.long):
            out[:, b] = [distance(a, self.tokens[b]) for a in texts]
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(texts), self.block):
            rows = order[at : at + self.block]
            size = sizes[rows]
            code = self.coded("".join(texts[k] for k in rows))
            first = np.cumsum(size) - size
            up, down = self._start(len(rows))
            for t in range(int(size[0])):
                n = int((size > t).sum())
                self._step(code[first[:n] + t], up[:n], down[:n])
            out[rows, self.long :] = self._far(size[:, None], up, down)
        return out

    def joined(self, r: tuple[str, ...], longest: int) -> list[np.ndarray]:
        """All compounds of two tokens of r or more: before which token they end, how many they are, the number of the token
        they are like, and how unlike it they are.

        From each token of r on its text is read on, and where another one ends, the distance is that of a compound. The
        more has been read, the fewer tokens are long enough.
        """
        most = 0
        while int(np.ceil((most + 1) * (1 - MOST_UNLIKE))) <= longest:
            most += 1
        stops = np.cumsum([0, *map(len, r)])
        starts, text = stops[:-1], "".join(r)
        code = self.coded(text)
        many = np.maximum(np.searchsorted(stops, starts + most, side="right") - np.arange(len(r)) - 2, 0)
        begin = np.repeat(np.arange(len(r)), many)
        stop = begin + 2 + np.arange(len(begin)) - np.repeat(np.cumsum(many) - many, many)
        size = stops[stop] - stops[begin]
        order = np.argsort(size, kind="stable")
        begin, stop = begin[order], stop[order]
        until = np.searchsorted(size[order], np.arange(most + 2))
        # Those tokens of which a text of each size may be a compound.
        low = np.searchsorted(-self.lengths, [-int(np.ceil(s * (1 - MOST_UNLIKE))) for s in range(most + 1)], side="right")
        high = np.searchsorted(-self.lengths, [-int(s / (1 - MOST_UNLIKE)) for s in range(most + 1)], side="left")
        out: list[tuple[np.ndarray, ...]] = []

        def keep(p: np.ndarray, e: np.ndarray, s: int, far: np.ndarray, first: int) -> None:
            unlike = far / np.maximum(np.maximum(s, self.lengths[first : first + far.shape[1]]), 1)
            which, b = np.nonzero(unlike <= MOST_UNLIKE)
            out.append((e[which], e[which] - p[which], b + first, unlike[which, b]))

        for at in range(0, len(r), self.block):
            end = min(at + self.block, len(r))
            up, down = self._start(end - at)
            for s in range(most + 1):
                n, wide = int(np.searchsorted(starts[at:end], len(text) - s, side="right")), max(0, int(low[s]) - self.long)
                if s and n and wide:
                    self._step(code[starts[at : at + n] + s - 1], up[:n, :wide], down[:n, :wide])
                p, e = begin[until[s] : until[s + 1]], stop[until[s] : until[s + 1]]
                own = (p >= at) & (p < end)
                p, e = p[own], e[own]
                if not len(p):
                    continue
                first = max(int(high[s]), self.long)
                if first - self.long < wide:
                    which = slice(first - self.long, wide)
                    keep(p, e, s, self._far(s, up[p - at, which], down[p - at, which], which), first)
                for b in range(int(high[s]), min(int(low[s]), self.long)):
                    keep(p, e, s, np.array([[distance(text[stops[x] : stops[y]], self.tokens[b])] for x, y in zip(p.tolist(), e.tolist(), strict=True)]), b)
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]


def _tables(group: list[_Task]) -> Iterator[np.ndarray]:
    """For each pair the steps of its table: 0 delete, 1 insert, 2 diagonal, k + 1 a compound of k."""
    prices = [t.prices() for t in group]
    n, m = max(len(t.r) for t in group), max(len(t.h) for t in group)
    base = np.cumsum([0, *(cost.size for cost, *_ in prices)])
    flat = np.concatenate([*(cost.ravel() for cost, *_ in prices), [0.0]])
    row, column = np.zeros((n, len(group)), np.int64), np.zeros((len(group), m), np.int64)
    for g, (cost, of_r, of_h, _) in enumerate(prices):
        row[: len(of_r), g] = base[g] + of_r * cost.shape[1]
        column[g, : len(of_h)] = of_h
    stop, parts, place, unlike = (np.concatenate([c[x] for *_, c in prices]) for x in range(4))
    whose = np.repeat(np.arange(len(group)), [len(c[0]) for *_, c in prices])
    order = np.lexsort((parts, stop))
    stop, parts, place, unlike, whose = (x[order] for x in (stop, parts, place, unlike, whose))
    cuts = np.flatnonzero((np.diff(stop, prepend=-1) != 0) | (np.diff(parts, prepend=-1) != 0)).tolist()
    at_row: dict[int, list[tuple[int, slice]]] = {}
    for a, b in zip(cuts, [*cuts[1:], len(stop)]):
        at_row.setdefault(int(stop[a]), []).append((int(parts[a]), slice(a, b)))
    most = int(parts.max(initial=1))
    at = np.arange(m + 1)
    # Only so many rows of costs are kept as a compound reaches back.
    kept = [np.empty(0)] * (most + 1)
    kept[0] = np.repeat(at[None].astype(float), len(group), 0)
    steps = np.ones((n + 1, len(group), m + 1), np.int8 if most < 126 else np.int32)
    for i in range(1, n + 1):
        above, how = kept[(i - 1) % (most + 1)], steps[i]
        best = np.empty((len(group), m + 1))
        best[:, 0] = i
        best[:, 1:] = above[:, :-1] + flat[row[i - 1][:, None] + column]
        how[...] = 2
        how[:, 0] = 0
        over = above[:, 1:] + 1
        less = over < best[:, 1:]
        best[:, 1:][less] = over[less]
        how[:, 1:][less] = 0
        for k, own in at_row.get(i, ()):
            g, j = whose[own], place[own]
            value = kept[(i - k) % (most + 1)][g, j] + 0.5 + unlike[own]
            less = value < best[g, j + 1]
            best[g[less], j[less] + 1] = value[less]
            how[g[less], j[less] + 1] = k + 1
        lowest = np.minimum.accumulate(best - at, axis=1) + at
        how[lowest < best - 1e-9] = 1
        kept[i % (most + 1)] = lowest
    return (steps[:, g] for g in range(len(group)))


def compound_align(ref: Column, hyp: Column, normalized: bool = True) -> Column:
    """The compound-aware alignment of two token arrays, as OPS. `hyp_idx` is always null: a token may be in several."""
    from pyspark.sql.pandas.functions import arrow_udf

    field = "norm" if normalized else "raw"

    @arrow_udf(OPS)
    def ops(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([compound_ops(a[k : k + ROWS], b[k : k + ROWS], field) for k in range(0, max(1, len(a)), ROWS)])

    return ops(ref, hyp)


def compound_ops(a: pa.Array, b: pa.Array, field: str) -> pa.ListArray:
    """The alignments of the token arrays of a and b, of type OPS."""
    left, right = _Side(a, field), _Side(b, field)
    raws = [side.flatten().field("raw").to_pylist() for side in (a, b)]
    seen: dict[str, str] = {x: plain(x) for x in {*raws[0], *raws[1]}} if field == "norm" else {}
    ref = [seen.get(x, x) for x in raws[0]]
    # Cutting needs normalized and raw text to have the same length; where they don't, raw text is compared.
    hyp = [y if len(y := seen.get(x, x)) == len(x) else x for x in raws[1]]
    there = (a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)).tolist()
    bounds = list(zip(left.starts.tolist(), left.ends.tolist(), right.starts.tolist(), right.ends.tolist(), strict=True))
    scripts = iter(compound_scripts([(ref[s:e], hyp[t:f]) for valid_, (s, e, t, f) in zip(there, bounds, strict=True) if valid_]))
    kinds, at_ref, at_hyp, lp, rp, sizes, pieces = [], [], [], [], [], [0], []
    for valid_, (s, _, t, _) in zip(there, bounds, strict=True):
        for kind, i, j, x, y, before, after in next(scripts) if valid_ else ():
            if before or after:
                pieces.append((len(kinds), t + j, x, y))
            kinds.append(OP_TYPES[kind])
            at_ref.append(-1 if i is None else s + i)
            at_hyp.append(-1 if j is None else t + j)
            lp.append(before)
            rp.append(after)
        sizes.append(len(kinds))
    i, j = np.array(at_ref, np.int64), np.array(at_hyp, np.int64)
    made = {f"ref{k}": v for k, v in left.taken(i).items()} | {f"hyp{k}": v for k, v in right.taken(j).items()}
    if pieces:
        at, token, x, y = (np.array(v, np.int64) for v in zip(*pieces, strict=True))
        cut = [(t if len(t) == len(raw) else raw)[p:q] for t, raw, p, q in zip(right.text.take(pa.array(token)).to_pylist(), (raws[1][k] for k in token), x, y, strict=True)]
        own = np.where(j < 0, -1, j)
        own[at] = len(right.text) + np.arange(len(at))
        made["hyp"] = pa.concat_arrays([right.text.cast(pa.string()), pa.array(cut, pa.string())]).take(pa.array(own, mask=own < 0))
        start = right.first.take(pa.array(token)).to_numpy(zero_copy_only=False)
        for name, change in (("hyp_start", x), ("hyp_end", y)):
            value = made[name].fill_null(0).to_numpy(zero_copy_only=False).copy()
            value[at] = start + change
            made[name] = pa.array(value, mask=j < 0)
    no = pa.array(np.zeros(len(kinds), bool))
    made |= {"type": pa.array(list(OP_TYPES)).take(pa.array(kinds, pa.int8())), "hyp_idx": pa.nulls(len(kinds), pa.int32()), "hyp_lp": pa.array(lp, pa.bool_()), "hyp_rp": pa.array(rp, pa.bool_()), "ref_lp": no, "ref_rp": no}
    flat = pa.StructArray.from_arrays([made[f.name].cast(f.type) for f in _OP_ARROW.value_type], fields=list(_OP_ARROW.value_type))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32(), mask=np.array([*(not x for x in there), False])), flat)


class _Spans:
    """The spans of a batch of array<struct<vocab, side, s, e>>, row by row."""

    def __init__(self, spans: pa.Array) -> None:
        flat, sizes = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.ref = pc.equal(flat.field("side"), "ref").to_numpy(zero_copy_only=False).astype(bool)
        self.first, self.stop = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("s", "e"))

    def own(self, row: int) -> slice:
        return slice(int(self.at[row]), int(self.at[row + 1]))


#: How many terms both sides have, and how many of the reference's are right and wrong, and of the hypothesis's wrong.
TERM_COUNTS = ("num_ref_terms", "num_hyp_terms", "num_tp", "num_fn", "num_fp")


def term_counts(ref: Column, hyp: Column, spans: Column) -> Column:
    """TERM_COUNTS of two arrays of strings with spans of terms: a term is right if all operations from its first to its last
    token are matches. Texts without spans aren't aligned."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf(f"struct<{','.join(f'{x}:long' for x in TERM_COUNTS)}>")
    def counts_(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        made, spans = np.zeros((len(a), len(TERM_COUNTS)), np.int64), _Spans(m)
        for row in np.flatnonzero(np.diff(spans.at)).tolist():
            own = spans.own(row)
            kinds = np.array(script(a[row].as_py(), b[row].as_py())[0], np.int8)
            wrong = np.concatenate([[0], np.cumsum(kinds != OP_TYPES[MATCH])])
            of_ref, first, last = spans.ref[own], spans.first[own], spans.stop[own] - 1
            bad = np.zeros(len(first), bool)
            for side, other in ((of_ref, INSERT), (~of_ref, DELETE)):
                at = np.flatnonzero(kinds != OP_TYPES[other])
                bad[side] = wrong[at[last[side]] + 1] > wrong[at[first[side]]]
            made[row] = of_ref.sum(), (~of_ref).sum(), (of_ref & ~bad).sum(), (of_ref & bad).sum(), (~of_ref & bad).sum()
        return pa.StructArray.from_arrays([pa.array(made[:, k]) for k in range(len(TERM_COUNTS))], list(TERM_COUNTS))

    return counts_(ref, hyp, spans)


def _side_text(ops: range, text: list[str | None], start: list[int | None], end: list[int | None]) -> str:
    """The same as `joined_side`."""
    out, until = "", 0
    for k in ops:
        if text[k] is not None:
            out += (" " if out and start[k] > until else "") + text[k]
            until = until if end[k] is None else end[k]
    return out.strip(SPACES)


def term_edits(ref: Column, hyp: Column, spans: Column, normalized: bool = True) -> Column:
    """For each span of the reference: the character edits and characters of its text, and its operations in the compound
    alignment, as array<struct<char_edits, ref_chars, segment>>. Texts without spans of the reference aren't aligned."""
    from pyspark.sql.pandas.functions import arrow_udf

    field = "norm" if normalized else "raw"

    @arrow_udf(f"array<struct<char_edits:long,ref_chars:long,segment:{OPS}>>")
    def stats(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return pa.concat_arrays([_term_edits(a[k : k + ROWS], b[k : k + ROWS], m[k : k + ROWS], field) for k in range(0, max(1, len(a)), ROWS)])

    return stats(ref, hyp, spans)


def _term_edits(a: pa.Array, b: pa.Array, m: pa.Array, field: str) -> pa.ListArray:
    spans = _Spans(m)
    rows = [row for row in range(len(a)) if spans.ref[spans.own(row)].any()]
    which = pa.array(rows, pa.int64())
    ops = compound_ops(a.take(which), b.take(which), field)
    flat, bounds = ops.values, ops.offsets.to_pylist()
    columns_ = {x: flat.field(x).to_pylist() for x in ("ref", "ref_start", "ref_end", "hyp", "hyp_start", "hyp_end", "hyp_lp", "hyp_rp")}
    sides = [[columns_[f"{side}{x}"] for x in ("", "_start", "_end")] for side in ("ref", "hyp")]
    of_ref = flat.field("ref_idx").is_valid().to_numpy(zero_copy_only=False)
    edits, chars, taken, ends_, sizes = [], [], [], [0], np.zeros(len(a), np.int64)
    for row, begin, end in zip(rows, bounds, bounds[1:], strict=False):
        own = spans.own(row)
        at = begin + np.flatnonzero(of_ref[begin:end])
        mine = spans.ref[own]
        for s, e in zip(at[spans.first[own][mine]].tolist(), at[spans.stop[own][mine] - 1].tolist(), strict=True):
            r, h = (_side_text(range(s, e + 1), *x) for x in sides)
            edits.append(distance(r, h) + columns_["hyp_lp"][s] + columns_["hyp_rp"][e])
            chars.append(len(r))
            taken.extend(range(s, e + 1))
            ends_.append(len(taken))
            sizes[row] += 1
    segments = pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), flat.take(pa.array(taken, pa.int64())))
    made = pa.StructArray.from_arrays([pa.array(edits, pa.int64()), pa.array(chars, pa.int64()), segments], ["char_edits", "ref_chars", "segment"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), made)


def count(ops: Column, *types: str) -> Column:
    return F.size(F.filter(ops, lambda o: o["type"].isin(*types))).cast("long")


def counts(ops: Column) -> dict[str, Column]:
    """num_matches, num_substitutions, num_insertions, num_deletions, num_edits and num_ops of an alignment."""
    return {
        "num_matches": count(ops, MATCH),
        "num_substitutions": count(ops, SUBSTITUTE),
        "num_insertions": count(ops, INSERT),
        "num_deletions": count(ops, DELETE),
        "num_edits": count(ops, SUBSTITUTE, INSERT, DELETE),
        "num_ops": F.size(ops).cast("long"),
    }


def index_mapping(ops: Column, side: str = "ref") -> Column:
    """map from a token's index to that of its operation; of several operations the last counts."""
    pairs = F.filter(F.transform(ops, lambda o, i: F.struct(o[f"{side}_idx"].alias("t"), i.alias("o"))), lambda p: p["t"].isNotNull())
    # Alignments are monotone, so operations on one token are neighbours.
    last = lambda ps: F.filter(ps, lambda p, i: ~F.equal_null(F.get(ps, i + 1)["t"], p["t"]))
    return F.map_from_entries(let(pairs, last))


def place(ops: Column, index: Column, side: str = "ref") -> Column:
    """The place (from 0) of the last operation on a token, or null."""
    return F.array_max(F.transform(ops, lambda o, i: F.when(o[f"{side}_idx"] == index, i)))


def ops_between(ops: Column, start: Column, stop: Column | None = None, side: str = "ref") -> Column:
    """The operations from one token's to another's, both included, with the insertions between them."""
    stop = start if stop is None else stop
    a, b = place(ops, start, side), place(ops, stop, side)
    bad = F.raise_error(F.concat(F.lit("no operation for token "), start.cast("string"), F.lit(" or "), stop.cast("string"), F.lit(", or they are out of order")))
    return F.when(a.isNull() | b.isNull() | (stop < start), bad.cast(OPS)).otherwise(F.slice(ops, a + 1, b - a + 1))


def places(ops: Column, side: str = "ref") -> Column:
    """The place (from 0) of each token's operation, by the token's number."""
    return F.filter(F.transform(ops, lambda o, i: F.when(o[f"{side}_idx"].isNotNull(), i)), lambda i: i.isNotNull())


def segment(ops: Column, at: Column, start: Column, stop: Column) -> Column:
    """The operations of the tokens start to stop - 1, `at` being the `places` of a side."""
    return F.slice(ops, F.get(at, start) + 1, F.get(at, stop - 1) - F.get(at, start) + 1)


def op_at(ops: Column, offset: Column, end: bool = False) -> Column:
    """The last operation whose reference text starts (or ends) at a character offset."""
    field = "ref_end" if end else "ref_start"
    return F.get(F.filter(ops, lambda o: o[field] == offset), F.size(F.filter(ops, lambda o: o[field] == offset)) - 1)


def valid(ops: Column) -> Column:
    """Whether each operation has the sides its type asks for."""
    both = lambda o: o["ref"].isNotNull() & o["hyp"].isNotNull()
    return F.forall(
        ops,
        lambda o: F.when(o["type"] == INSERT, o["ref"].isNull() & o["hyp"].isNotNull()).when(o["type"] == DELETE, o["ref"].isNotNull() & o["hyp"].isNull()).otherwise(both(o)),
    )


def joined_side(ops: Column, side: str) -> Column:
    """One side of a run of operations as text, with spaces where the text had gaps; nothing comes before the first word."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))

    def add(acc: Column, o: Column) -> Column:
        gap = F.when((acc["text"] != "") & (o[f"{side}_start"] > acc["end"]), F.lit(" ")).otherwise(F.lit(""))
        return F.when(o[side].isNull(), acc).otherwise(F.struct(F.concat(acc["text"], gap, o[side]).alias("text"), F.coalesce(o[f"{side}_end"], acc["end"]).alias("end")))

    return F.regexp_replace(F.aggregate(ops, start, add, lambda acc: acc["text"]), r"(?U)^\s+|\s+\z", "")


def longest_run(ops: Column, kind: str = INSERT) -> Column:
    """The length of the longest run of operations of a type."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def add(acc: Column, o: Column) -> Column:
        now = F.when(o["type"] == kind, acc["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(ops, start, add, lambda acc: acc["most"])
