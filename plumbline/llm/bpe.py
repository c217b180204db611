"""Byte-pair encodings of all prefixes at once.

The encoding of a prefix is the encoding of a shorter prefix and one last token;
of the tokens that end at a boundary exactly one follows the shorter prefix's last
token in a way the merges allow. So one pass over the boundaries gives the last
token of every prefix, with no encoding done twice. Whether two tokens may stand
side by side is a matter of the two alone, and is told from how each was merged.
"""

from __future__ import annotations

#: Remembered pairs of tokens; beyond this they are forgotten together.
MAX_PAIRS = 1_000_000
MAX_GENERATION = 350_000
SPAN = 1 << 24


class PrefixEncoder:
    """Works on ``str`` or ``bytes``, as the keys of ``ranks`` are; lower ranks merge first, then leftmost ones."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        #: Numbers of the tokens, and of atoms that are none as they come; 0 stands for the start.
        self.numbers: dict = {t: i for i, t in enumerate(ranks, 1)}
        self.tokens: list = [None, *ranks]
        self.pairs: dict[int, bool] = {}
        self.splits: dict = {}
        seen: dict = {}
        for t, r in ranks.items():
            if len(t) > 1:
                seen.setdefault(r, []).append(t)
        tied = [t for ts in seen.values() if len(ts) > 1 for t in ts]
        #: The shortest tokens of shared ranks; texts with these are merged step by step.
        self.tied = [t for t in tied if not any(u in t and u != t for u in tied)]

    def merged(self, s) -> list:
        """The tokens of ``s`` by merging, step by step; atoms that are no token stay as they are."""
        ranks = self.ranks
        parts = [s[i : i + 1] for i in range(len(s))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def split(self, token):
        """The two tokens whose merge makes ``token``, () for an atom, None if merging doesn't give it."""
        found = self.splits.get(token, 0)
        if found == 0:
            if len(token) == 1:
                found = ()
            else:
                ranks, parts, found = self.ranks, [token[i : i + 1] for i in range(len(token))], None
                while len(parts) > 1:
                    pairs = [(ranks[t], i) for i in range(len(parts) - 1) if (t := parts[i] + parts[i + 1]) in ranks]
                    if not pairs:
                        break
                    at = min(pairs)[1]
                    if len(parts) == 2:
                        found = (parts[0], parts[1])
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = found
        return found

    def atom(self, c) -> int:
        """The number of an atom that is no token."""
        self.tokens.append(c)
        self.numbers[c] = len(self.tokens) - 1
        return self.numbers[c]

    def may_follow(self, pair: int) -> bool:
        """Whether merging ``a + b`` gives a, b: no merge across their border comes before those inside.

        ``pair`` is a's number times SPAN plus b's number.
        """
        ok = self.pairs.get(pair)
        if ok is None:
            a, b = self.tokens[pair // SPAN], self.tokens[pair % SPAN]
            ok = self.split(b) is not None if a is None else self._apart(a, b)
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = ok
        return ok

    def _apart(self, a, b) -> bool:
        ranks, split = self.ranks, self.split
        if self.tied and any(t in a + b for t in self.tied):
            return self.merged(a + b) == [a, b]
        if split(a) is None or split(b) is None:
            return False
        limit = float("inf")
        while True:
            across = ranks.get(a + b)
            if across is not None and across < limit:
                return False
            # Undo the later of the two merges next to the border. Of equal ranks the left one merges first.
            left, right = split(a), split(b)
            if left and (not right or ranks[a] > ranks[b]):
                limit, a = ranks[a], left[1]
            elif right:
                limit, b = ranks[b] + 0.5, right[0]
            else:
                return True

    def extend(self, s, last: list[int], back: list[int]) -> None:
        """Continues ``last`` (number of the last token) and ``back`` (where it starts) to all prefixes of ``s``."""
        numbers, known, longest, may_follow = self.numbers.get, self.pairs.get, self.longest, self.may_follow
        for i in range(len(last), len(s) + 1):
            token = numbers(s[i - 1 : i])
            if token is None:
                token = self.atom(s[i - 1 : i])
            j = i - 1
            stop = i - longest if i > longest else 0
            while True:
                if token is not None:
                    pair = last[j] * SPAN + token
                    ok = known(pair)
                    if ok or ok is None and may_follow(pair):
                        break
                j -= 1
                if j < stop:
                    raise AssertionError("no token may end here")
                token = numbers(s[j:i])
            last.append(token)
            back.append(j)

    def counts(self, s) -> list[int]:
        """The number of tokens of each prefix, from the empty one on."""
        back = [0]
        self.extend(s, [0], back)
        out = [0]
        for j in back[1:]:
            out.append(out[j] + 1)
        return out


class Memo(dict):
    """Remembers ``make(key)`` for the keys met last: at most two generations of MAX_GENERATION keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= MAX_GENERATION:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
