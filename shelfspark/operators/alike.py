"""Pairs of two blocks of keys whose similarity reaches a bound, found without a look at every pair.

Keys are those of `text.normalize_key`; similarity is that of `text.key_similarity`. Edits are counted along a tree of
prefixes, a column of the edit matrix as the bits of words (Myers), so keys with a common start share the work, and a
branch that no key can reach the bound from is left. Pairs that reach it by common words alone are found by their
rarest words. Both ways lose no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a key that are compared as numbers, folders that are followed at once, branches of fewer keys are not bounded.
WIDE, AT_ONCE, BUSHY = 12, 32, 8
_NONE = np.zeros(0, np.int64)
_SLACK = 1e-9


class Keys:
    """Distinct keys, empty ones left out, with the rows that have each, their words and their tree."""

    def __init__(self, rows: list[str], words: dict[str, int]) -> None:
        self.texts = sorted(set(rows) - {""})
        number = {t: i for i, t in enumerate(self.texts)}
        of = np.array([number.get(t, -1) for t in rows], np.int64)
        self.of = of
        order = np.argsort(of, kind="stable")
        order = order[of[order] >= 0]
        self.rows, self.count = order, np.bincount(of[order], minlength=len(self.texts))
        self.start = np.cumsum(self.count) - self.count
        self.length = np.array([len(t) for t in self.texts], np.int64)
        split = [dict.fromkeys(t.split(" ")) for t in self.texts]
        self.size = np.array([len(x) for x in split], np.int64)
        self.words = np.array([words.setdefault(w, len(words)) for x in split for w in x], np.int64)
        self.first = np.cumsum(self.size) - self.size
        narrow = np.repeat(self.size <= WIDE, self.size)
        key = np.repeat(np.arange(len(split)), self.size)
        self.matrix = np.full((len(split), min(WIDE, int(self.size.max(initial=1)))), -1, np.int64)
        self.matrix[key[narrow], (np.arange(len(key)) - self.first[key])[narrow]] = self.words[narrow]

    def own(self, i: int) -> set[int]:
        return set(self.words[self.first[i] : self.first[i] + self.size[i]].tolist())

    def tree(self) -> None:
        """Nodes by depth, those of a parent side by side: symbol, first child and children, keys below and their lengths, and the key that ends there."""
        n, t = len(self.texts), self.texts
        common = np.zeros(n, np.int64)
        for i in range(1, n):
            a, b = t[i - 1], t[i]
            k, m = 0, min(len(a), len(b))
            while k < m and a[k] == b[k]:
                k += 1
            common[i] = k
        new = self.length - common
        text = np.repeat(np.arange(n), new)
        depth = np.arange(len(text)) - np.repeat(np.cumsum(new) - new, new) + np.repeat(common, new)  # from 0
        at = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(t).encode("utf-32-le"), np.uint32)
        self.alphabet, symbols = np.unique(codes[at[text] + depth], return_inverse=True)
        order = np.lexsort((text, depth))
        text, depth, symbols = text[order], depth[order], symbols[order]
        self.deepest = int(self.length.max(initial=0))
        edge = np.searchsorted(depth, np.arange(self.deepest + 1))
        self.levels = []
        for d in range(self.deepest):
            own = text[edge[d] : edge[d + 1]]
            self.levels.append({"text": own, "symbol": symbols[edge[d] : edge[d + 1]], "end": np.where(self.length[own] == d + 1, own, -1)})
        below = None
        for d in range(self.deepest - 1, -1, -1):
            level = self.levels[d]
            ends = level["end"] >= 0
            level["keys"] = ends.astype(np.int64)
            level["least"], level["most"] = np.where(ends, d + 1, 1 << 40), np.where(ends, d + 1, 0)
            level["children"], level["first"] = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            if below is not None:
                parent = np.searchsorted(level["text"], below["text"], side="right") - 1
                level["children"] = np.bincount(parent, minlength=len(ends))
                level["first"] = np.cumsum(level["children"]) - level["children"]
                level["keys"] += np.bincount(parent, below["keys"], len(ends)).astype(np.int64)
                np.minimum.at(level["least"], parent, below["least"])
                np.maximum.at(level["most"], parent, below["most"])
            below = level
        spans = np.unique(np.concatenate([lv["least"] * (self.deepest + 1) + lv["most"] for lv in self.levels])) if n else _NONE
        self.spans = np.stack([spans // (self.deepest + 1), spans % (self.deepest + 1)], 1)
        for level in self.levels:
            level["span"] = np.searchsorted(spans, level["least"] * (self.deepest + 1) + level["most"])


def common_words(a: Keys, i: np.ndarray, b: Keys, j: np.ndarray) -> np.ndarray:
    """How many words the keys i of a and j of b share, pair by pair."""
    n = np.zeros(len(i), np.int64)
    for x in range(a.matrix.shape[1]):
        w = a.matrix[i, x]
        for y in range(b.matrix.shape[1]):
            n += (w >= 0) & (w == b.matrix[j, y])
    for r in np.flatnonzero((a.size[i] > WIDE) | (b.size[j] > WIDE)):
        n[r] = len(a.own(i[r]) & b.own(j[r]))
    return n


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between texts, pair by pair."""
    out = np.zeros(len(a), np.int64)
    order = np.argsort([len(x) * 4096 + len(y) for x, y in zip(a, b, strict=True)], kind="stable")
    for part in np.array_split(order, max(1, len(order) // 512)):
        la, lb = np.array([len(a[r]) for r in part], np.int64), np.array([len(b[r]) for r in part], np.int64)
        m, n = int(la.max(initial=0)), int(lb.max(initial=0))
        x, y = np.zeros((len(part), m), np.int64), np.zeros((len(part), n), np.int64)
        for r, at in enumerate(part):
            x[r, : la[r]], y[r, : lb[r]] = [ord(c) for c in a[at]], [ord(c) for c in b[at]]
        steps = np.arange(n + 1)
        row = np.repeat(steps[None, :], len(part), 0)
        got = lb.copy()
        for i in range(m):
            cheap = np.minimum(row[:, 1:] + 1, row[:, :-1] + (x[:, i : i + 1] != y))
            row = np.minimum.accumulate(np.concatenate([np.full((len(part), 1), i + 1), cheap], 1) - steps, 1) + steps
            here = la == i + 1
            got[here] = row[here, lb[here]]
        out[part] = got
    return out


def _allowed(m: int, deepest: int, bound: float) -> np.ndarray:
    """By length of the other key: the most edits at which a key of length m may still reach the bound, -1 if none."""
    n = np.arange(deepest + 1)
    share = np.where(np.minimum(n, m) >= 6, bound / 0.95, (bound - 0.4) / 0.6)
    longer = np.maximum(n, m)
    most = np.floor((1 - share) * longer + 1e-6).astype(np.int64)
    most = np.where(share > 1, np.where(bound <= 1, 0, -1), np.minimum(most, longer))  # equal keys are alike whatever they hold
    return np.where(most < np.abs(n - m), -1, most)


def near(f: Keys, picked: np.ndarray, p: Keys, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys of f, keys of p, edits) of all pairs that edits may lift to the bound, for the picked keys of f, some at a time."""
    for m in np.unique(f.length[picked]):
        most = _allowed(int(m), p.deepest, bound)
        by_span = np.array([most[lo : hi + 1].max() for lo, hi in p.spans], np.int64) if len(p.spans) else _NONE
        same = picked[f.length[picked] == m]
        for at in range(0, len(same), AT_ONCE):
            yield _follow(f, same[at : at + AT_ONCE], int(m), p, most, by_span)


def _follow(f: Keys, group: np.ndarray, m: int, p: Keys, most: np.ndarray, by_span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`near` for keys of one length: their columns go down the tree together."""
    parts, letters = -(-m // 64), len(p.alphabet)
    codes = np.frombuffer("".join(f.texts[i] for i in group).encode("utf-32-le"), np.uint32).reshape(len(group), m)
    known = np.minimum(np.searchsorted(p.alphabet, codes), letters - 1)
    has = p.alphabet[known] == codes
    masks = np.zeros((parts, len(group) * letters), np.uint64)
    for i in range(m):
        r = np.flatnonzero(has[:, i])
        masks[i // 64, r * letters + known[r, i]] |= np.uint64(1 << (i % 64))
    one, ends = np.uint64(1), np.uint64((1 << (m - 64 * (parts - 1))) - 1)
    who, node = np.arange(len(group)), None
    up, down = [np.full(len(group), ~np.uint64(0)) for _ in range(parts)], [np.zeros(len(group), np.uint64) for _ in range(parts)]
    found = [(_NONE, _NONE, _NONE)]
    for d, level in enumerate(p.levels):
        if node is None:
            many, first = np.full(len(who), len(level["text"])), np.zeros(len(who), np.int64)
        else:
            above = p.levels[d - 1]
            many, first = above["children"][node], above["first"][node]
        back, node = _spread(many, first)
        if not len(back):
            break
        who = who[back]
        seen = who * letters + level["symbol"][node]
        carry_up, carry_down = one, None
        for w in range(parts):
            eq, vp, vn = masks[w][seen], up[w][back], down[w][back]
            xv = eq | vn
            if carry_down is not None:
                eq |= carry_down
            xh = (((eq & vp) + vp) ^ vp) | eq
            hp, hn = vn | ~(xh | vp), vp & xh
            next_up, next_down = (hp >> np.uint64(63), hn >> np.uint64(63)) if w + 1 < parts else (one, None)
            hp, hn = (hp << one) | carry_up, hn << one
            if carry_down is not None:
                hn |= carry_down
            up[w], down[w] = hn | ~(xv | hp), hp & xv
            carry_up, carry_down = next_up, next_down
        end = np.flatnonzero(level["end"][node] >= 0) if most[d + 1] >= 0 else _NONE
        if len(end):
            far = np.full(len(end), d + 1, np.int64)
            for w in range(parts):
                held = ends if w == parts - 1 else ~np.uint64(0)
                far += np.bitwise_count(up[w][end] & held).astype(np.int64) - np.bitwise_count(down[w][end] & held)
            ok = far <= most[d + 1]
            found.append((group[who[end[ok]]], level["end"][node[end[ok]]], far[ok]))
        # a branch is left if no cell of the column leads to an end within the bound
        limit = by_span[level["span"][node]]
        keep = (level["children"][node] > 0) & (limit >= 0)
        try_ = np.flatnonzero(keep & (level["keys"][node] >= BUSHY))
        if len(try_):
            lo, hi = level["least"][node[try_]] - d - 1, level["most"][node[try_]] - d - 1
            cell = np.full(len(try_), d + 1, np.int64)
            best = cell + np.maximum(0, np.maximum(lo - m, m - hi))
            for i in range(1, m + 1):
                w, bit = (i - 1) // 64, np.uint64((i - 1) % 64)
                if not (i - 1) % 64:
                    vp, vn = up[w][try_], down[w][try_]
                cell += ((vp >> bit) & one).astype(np.int64) - ((vn >> bit) & one).astype(np.int64)
                np.minimum(best, cell + np.maximum(0, np.maximum(lo - (m - i), m - i - hi)), out=best)
            keep[try_[best > limit[try_]]] = False
        stay = np.flatnonzero(keep)
        who, node = who[stay], node[stay]
        up, down = [x[stay] for x in up], [x[stay] for x in down]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spread(lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a run, position) of every position of runs of such lengths and first positions."""
    back = np.repeat(np.arange(len(lengths)), lengths)
    return back, np.arange(len(back)) + (first - np.cumsum(lengths) + lengths)[back]


class Listed:
    """Keys by number, several to a number."""

    def __init__(self, numbers: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(numbers, kind="stable")
        self.numbers, self.keys = numbers[order], keys[order]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in numbers, key) of all keys listed under them."""
        lo = np.searchsorted(self.numbers, numbers)
        back, at = _spread(np.searchsorted(self.numbers, numbers, side="right") - lo, lo)
        return back, self.keys[at]


class Rare:
    """The keys of a block by their words, each key's rarest first; `words` are known in all."""

    def __init__(self, p: Keys, words: int) -> None:
        self.often, self.words = np.bincount(p.words, minlength=words), words
        key, rank, word = self.ranked(p, np.arange(len(p.texts)))
        self.sizes, kind = np.unique(p.size, return_inverse=True)
        self.most = int(p.size.max(initial=0))
        self.placed = Listed((kind[key] * self.most + rank) * words + word, key)
        self.all, self.rarest = Listed(word, key), Listed(word[rank == 0], key[rank == 0])

    def ranked(self, f: Keys, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, rank, word) of the words of the picked keys, rank 0 the rarest here."""
        back, at = _spread(f.size[picked], f.first[picked])
        word = f.words[at]
        order = np.lexsort((word, self.often[word], back))
        return picked[back], np.arange(len(back)) - (np.cumsum(f.size[picked]) - f.size[picked])[back], word[order]


def _distinct(i: list[np.ndarray], j: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.concatenate([_NONE, *i]) * n + np.concatenate([_NONE, *j]))
    return pairs // n, pairs % n


def worded(f: Keys, picked: np.ndarray, p: Keys, rare: Rare, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys of f, keys of p) of all pairs with at least `share` of their words in common, and some others."""
    key, rank, word = rare.ranked(f, picked)
    i, j = [], []
    for kind, size in enumerate(rare.sizes.tolist()):
        both = np.maximum(1, np.ceil(share / (1 + share) * (f.size[key] + size) - 1e-6).astype(np.int64))
        probe = (both <= size) & (rank <= f.size[key] - both)
        for place in range(size - int(both[probe].min(initial=size + 1)) + 1):
            at = np.flatnonzero(probe & (place <= size - both))
            back, found = rare.placed.of((kind * rare.most + place) * rare.words + word[at])
            i.append(key[at[back]])
            j.append(found)
    return _distinct(i, j, len(p.texts))


def contained(f: Keys, picked: np.ndarray, p: Keys, rare: Rare) -> tuple[np.ndarray, np.ndarray]:
    """(keys of f, keys of p) of all pairs where the shorter key's words all are words of the other."""
    key, rank, word = rare.ranked(f, picked)
    back, found = rare.rarest.of(word)
    least = rank == 0
    again, more = rare.all.of(word[least])
    i, j = _distinct([key[back], key[least][again]], [found, more], max(1, len(p.texts)))
    short = f.length[i] <= p.length[j]
    yes = common_words(f, i, p, j) == np.where(short, f.size[i], p.size[j])
    return i[yes], j[yes]


def inside(f: Keys, picked: np.ndarray, s: Keys, shortest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(keys of f, keys of s) of all pairs where the second, of `shortest` letters at least, stands in the first."""
    known = {t: j for j, t in enumerate(s.texts) if len(t) >= shortest}
    sizes, out = sorted({len(t) for t in known}), ([], [])
    for i in picked.tolist():
        text = f.texts[i]
        got = {known[part] for n in sizes for at in range(len(text) - n + 1) if (part := text[at : at + n]) in known}
        out[0].extend([i] * len(got))
        out[1].extend(got)
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def alike(f: Keys, i: np.ndarray, p: Keys, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """`text.key_similarity` of pairs of keys with so many edits."""
    n = common_words(f, i, p, j)
    edit = 1 - far / np.maximum(f.length[i], p.length[j])
    jaccard = n / (f.size[i] + p.size[j] - n)
    long = (f.length[i] >= 6) & (p.length[j] >= 6)
    return np.where(far == 0, 1.0, np.maximum(0.4 * jaccard + 0.6 * edit, np.where(long, 0.95 * edit, 0.0)))


def similar(f: Keys, picked: np.ndarray, p: Keys, rare: Rare, bound: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys of f, keys of p, similarity) of all pairs that reach the bound, some twice."""
    if not len(p.texts):
        return
    # where edits fall short of the bound alone, so much of the words must be common
    share = bound * (1 - 0.6 / 0.95) / 0.4 - _SLACK
    if 0 < share <= 1:
        i, j = worded(f, picked, p, rare, share)
        n = common_words(f, i, p, j)
        enough = n >= share * (f.size[i] + p.size[j] - n)
        i, j = i[enough], j[enough]
        score = alike(f, i, p, j, edits([f.texts[x] for x in i], [p.texts[x] for x in j]))
        yield i[score >= bound], j[score >= bound], score[score >= bound]
    for i, j, far in near(f, picked, p, bound):
        score = alike(f, i, p, j, far)
        yield i[score >= bound], j[score >= bound], score[score >= bound]


def _rows(a: Keys, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in i, row) of all rows that have the keys."""
    back, at = _spread(a.count[i], a.start[i])
    return back, a.rows[at]


def _codes(values: list, known: dict) -> np.ndarray:
    return np.array([-1 if v is None else known.setdefault(v, len(known)) for v in values], np.int64)


def scores(x: dict[str, list], y: dict[str, list], least: float, every: bool, best: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of folders x, rows of products y, score before it is rounded) of pairs that reach `least`, some folders at a time.

    Both have k, sk, category and subcategory. Every way by which a pair may score is followed to the lowest value
    that, with the most that category and subcategory can add, still reaches `least`; the best way counts.
    """
    words, kinds, subs = {}, {}, {}
    f, names, skus = Keys(x["k"], words), Keys(y["k"], words), Keys(y["sk"], words)
    fc, yc, fs, ys = _codes(x["category"], kinds), _codes(y["category"], kinds), _codes(x["subcategory"], subs), _codes(y["subcategory"], subs)
    least -= 0.0006  # what rounding may add, and a little more
    add = np.where((fc >= 0) & np.isin(fc, yc), 0.08, 0.0) + np.where((fs >= 0) & np.isin(fs, ys), 0.06, 0.0)
    up = np.full(len(f.texts), 0.0)
    at, row = _rows(f, np.arange(len(f.texts)))
    np.maximum.at(up, at, add[row])
    for keys in (names, skus):
        keys.tree()
    by_name, by_sku, n = Rare(names, len(words)), Rare(skus, len(words)), len(y["k"])

    def finish(i: np.ndarray, j: np.ndarray, value: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-value, i * n + j))
        i, j, value = i[order], j[order], value[order]
        first = np.ones(len(i), bool)
        first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        i, j, value = i[first], j[first], value[first]
        move = np.where((fc[i] >= 0) & (fc[i] == yc[j]), 0.08, 0.0) + np.where((fs[i] < 0) | (ys[j] < 0), 0.0, np.where(fs[i] == ys[j], 0.06, -0.15))
        raw = np.maximum(0.0, np.minimum(1.0, value + move))
        keep = raw >= least
        if not every:
            shared = np.isin(i * n + j, held)
            for keys in (names, skus):
                both = np.flatnonzero(~shared & keep & (f.of[i] >= 0) & (keys.of[j] >= 0))
                shared[both] = common_words(f, f.of[i[both]], keys, keys.of[j[both]]) > 0
            keep &= shared
        i, j, raw = i[keep], j[keep], raw[keep]
        if best is not None and len(i):
            order = np.lexsort((-raw, i))
            i, j, raw = i[order], j[order], raw[order]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            size = np.diff(np.append(start, len(i)))
            keep = raw >= np.repeat(raw[start + np.minimum(size, best) - 1], size) - 0.00101  # these may be equal when rounded
            i, j, raw = i[keep], j[keep], raw[keep]
        return i, j, raw

    def put(out: list, keys: Keys, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        back, b = _rows(keys, j)
        again, a = _rows(f, i[back])
        out.append((a, b[again], value[back][again]))

    for most in np.unique(up):
        bound, same = least - most - _SLACK, np.flatnonzero(up == most)
        same = same[np.argsort(f.length[same], kind="stable")]
        for start in range(0, len(same), 8 * AT_ONCE):
            group, out = same[start : start + 8 * AT_ONCE], [(_NONE, _NONE, np.zeros(0))]
            for keys, rare in ((names, by_name), (skus, by_sku)):
                for i, j, value in similar(f, group, keys, rare, bound):
                    put(out, keys, i, j, value)
            held = _NONE
            if bound <= 0.95:
                i, j = inside(f, group, skus)
                put(out, skus, i, j, np.full(len(i), 0.95))
                held = out[-1][0] * n + out[-1][1]
            if bound <= 0.78:
                i, j = contained(f, group, names, by_name)
                put(out, names, i, j, np.full(len(i), 0.78))
            if bound <= 0:
                rows = _rows(f, group)[1]
                out.append((np.repeat(rows, n), np.tile(np.arange(n), len(rows)), np.zeros(len(rows) * n)))
            yield finish(*(np.concatenate(c) for c in zip(*out, strict=True)), held)
    if least <= add.max(initial=0):  # names without a letter or number
        for row in np.flatnonzero(f.of < 0):
            yield finish(np.full(n, row), np.arange(n), np.zeros(n), _NONE)
