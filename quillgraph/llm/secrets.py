"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they miss.

Base spans come from three patterns. The tagger cuts a text into tokens (runs of word characters and of marks that
credentials have, and single marks) and labels every one of them as begin, inside or outside of a secret, from its shape, the
words and marks next to it and features of the whole text; Viterbi finds the likeliest labels of the text.

A token's share in the scores of its own label and of its neighbours' depends on the token alone and is computed once
for each distinct one, so a text's scores are sums of table rows. Decoding is exact without a step for each token: a
run of labels other than outside can only be on the best path if its gains over outside, bounded token by token from
the scores and the moves, sum up to nothing lost. Tokens in no stretch with such a sum are outside on the best path;
the stretches are decoded between them.

The model is trained here from SAMPLE generated texts with known secrets, from a fixed seed; nothing is taken from the
tables.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, slices
from .crf import LinearChainCRF

# fixed values: the base patterns, their least lengths, and the order of kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "tagged")
MIN_ASSIGN, MIN_ACCESS = 6, 20

SAMPLE, SEEN = 3000, 4
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
MASK = "[SECRET]"
#: Neighbours whose words and marks are features.
AROUND = (-5, -4, -3, -2, -1, 1)
#: Distinct tokens that a worker keeps, and their characters.
KEPT, KEPT_CHARS = 300_000, 20_000_000

_TOKEN = re.compile(r"[^\x00-\x2a\x2c\x2e\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+(?:\.[^\x00-\x2a\x2c\x2e\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+)*|[!-,.:-@\[-^`{-~]")
_WORD = re.compile(r"[^\W\d_]+")
#: Words, or beginnings of words, that stand before credentials.
_LEXICON = re.compile(r"(?:^|[_.-])(?:key|apikey|token|secret|pass|pw|pwd|auth|bearer|basic|cred|private|client|access|session|sess|sig|cookie|login|pin|otp|jwt|ssh|aws|sas|hook|webhook|bot|license|licence|db|smtp|ftp|user|account|master|root|admin|encryption|signing|passcode|sha|hmac|salt)")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the base matches, by start and then kind; in code points."""
    out = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _shape(s: str) -> str:
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", s)))


#: Letters as vowels, frequent and rare consonants; words of one such pattern and case have the same own features.
_PATTERN = str.maketrans({**dict.fromkeys("aeiouyàáâäèéêëìíîïòóôöùúûü", "a"), **dict.fromkeys("bcdfghlmnprstñç", "b"), **dict.fromkeys("jkqvwxz", "c")})
PLAIN = 15


def plain(token: str) -> str | None:
    """Pattern and case of an ordinary short word; None for other tokens."""
    if len(token) > PLAIN or not token.isalpha():
        return None
    case = "l" if token.islower() else "u" if token.isupper() else "t" if token.istitle() else None
    return case and case + token.lower().translate(_PATTERN)


def own_features(token: str) -> list[str]:
    """Features of a token's shape; the first is its class."""
    if (p := plain(token)) is not None:
        return pattern_features(p)
    s = token[:256]  # of a longer token only the length counts beyond
    n = len(s)
    digits, upper, lower = (sum(map(f, s)) for f in (str.isdigit, str.isupper, str.islower))
    if not digits and not upper and not lower:
        return ["mark", f"is{s[:1]}", "bias"]
    size = n if n < 12 else 12 + min(8, (n - 12) // 4)
    turns = sum((a.isdigit() != b.isdigit()) or (a.islower() and b.isupper()) for a, b in zip(s, s[1:], strict=False))
    low = s.lower()
    messy = min(4, 10 * turns // n)
    hexa = not re.search(r"[^0-9a-fA-F]", s)
    group = "number" if digits == n else "hex" if hexa and digits and n >= 8 else "mixed" if digits and (upper or lower) and n >= 8 else "camel" if turns >= 2 else "long" if n >= 16 else "short"
    return [
        group, "bias", f"len{size}", f"kind{min(2, digits)}{min(2, upper)}{min(2, lower)}", f"kind{min(2, digits)}{min(2, upper)}{min(2, lower)} {size // 4}", f"dig{5 * digits // n}", f"ent{int(2 * _entropy(s))}", f"messy{messy} {size // 4}",
        *_spoken(low.translate(_PATTERN), size), f"shape{_shape(s)[:6]}", f"head{low[:4]}" if not s[:3].isdigit() else "head0", f"mark{'_' in s[:6]}{'-' in s[:6]}",
        f"dots{min(3, s.count('.'))}", f"slash{min(3, s.count('/'))}", f"dash{min(4, s.count('-'))}", f"under{min(3, s.count('_'))}", f"plus{min(2, s.count('+'))}", f"case{upper == 1 and s[0].isupper()}{upper == n}", f"beyond{s.isascii()}",
    ]


def _spoken(pattern: str, size: int) -> list[str]:
    """How a pattern's vowels and consonants follow each other."""
    letters = sum(map(pattern.count, "abc"))
    share = 5 * pattern.count("a") // letters if letters else 9
    run = max(map(len, re.findall("[bc]+", pattern)), default=0)
    return [f"vowels{share} {size // 4}", f"run{min(7, run)} {size // 4}", f"rare{min(4, pattern.count('c'))}"]


def pattern_features(pattern: str) -> list[str]:
    """Own features of the words of a case and pattern."""
    n = len(pattern) - 1
    size = n if n < 12 else 12
    return ["short", "bias", "plain", f"plain{pattern[0]}", f"len{size}", *_spoken(pattern[1:], size)]


#: Classes of tokens, by which pairs of neighbours are features.
_GROUPS = ("mark", "number", "hex", "mixed", "camel", "long", "short")


def near_features(token: str) -> list[str]:
    """Features of a token as its neighbours see it; the last is its class."""
    low = token[:64].lower()
    if not any(map(str.isalnum, low)):
        return [f"is{low[:1]}"]
    out = [f"word{w}" for w in _WORD.findall(low)[-3:]] if len(low) <= 24 else []
    if _LEXICON.search(low):
        out.append("credential")
    return [*out, f"group{own_features(token)[0]}"]


def text_features(counts: Counter) -> list[str]:
    """Features of a whole text, from its numbers of tokens by class and of some marks."""
    n = max(1, sum(counts[g] for g in _GROUPS))
    odd = counts["mixed"] + counts["hex"] + counts["camel"]
    return [f"odd{min(4, odd)}", f"rate{min(4, 40 * odd // n)}", f"set{min(3, 20 * (counts['='] + counts[':']) // n)}", f"quotes{min(2, 20 * counts['q'] // n)}", f"marks{min(4, 8 * counts['mark'] // n)}"]


def feature_names(tokens: list[str]) -> list[list[str]]:
    """The features of each token: its own, its neighbours', pairs of classes, and the text's."""
    own, near = [own_features(t) for t in tokens], [near_features(t) for t in tokens]
    cred, quote = ["credential" in x for x in near], [t in _QUOTES for t in tokens]
    counts = Counter(x[0] for x in own)
    counts["="], counts[":"], counts["q"] = tokens.count("="), tokens.count(":"), sum(quote)
    whole = [f"text {x}" for x in text_features(counts)]
    rows = []
    for i in range(len(tokens)):
        row = [f"own {x}" for x in own[i]]
        for o in AROUND:
            if 0 <= i + o < len(tokens):
                row += [f"{o} {x}" for x in near[i + o]]
        row.append(f"near {own[i][0]} {any(cred[max(0, i - 5) : i])} {i > 0 and quote[i - 1]}")
        row += [f"pair{k} {own[i][0]} {own[i + k][0]}" for k in (-1, 1) if 0 <= i + k < len(tokens)]
        rows.append(row + whole)
    return rows


_QUOTES = ("'", '"', "`")


class Tagger:
    """The trained model, and the features that it knows by number."""

    def __init__(self, model: LinearChainCRF, names: dict[str, int]) -> None:
        self.model, self.names = model, names

    def weights(self, features: list[str]) -> np.ndarray:
        get = self.names.get
        return self.model.weights[[get(x, 0) for x in features]].sum(axis=0)


class Known(dict):
    """Numbers by token; -1 for others."""

    def __missing__(self, token: str) -> int:
        return -1


class Tokens:
    """Distinct tokens as numbers, with what their scores need: what ``feature_names`` adds up to, by tables."""

    def __init__(self, tagger: Tagger) -> None:
        self.tagger, self.model = tagger, tagger.model
        weights = tagger.weights
        self.pairs = {k: np.array([[weights([f"pair{k} {a} {b}"]) for b in _GROUPS] for a in _GROUPS]) for k in (-1, 1)}
        self.close = np.array([[[weights([f"near {g} {n} {q}"]) for q in (False, True)] for n in (False, True)] for g in _GROUPS])
        self.words = {x.partition(" word")[2] for x in tagger.names if " word" in x}
        self.cleared()

    def cleared(self) -> None:
        self.known = Known()
        self.chars = 0
        self.own_rows: dict[str, int] = {}
        self.near_rows: dict[tuple[str, ...], int] = {}
        self.own_table = np.zeros((0, self.model.labels))
        self.near_table = np.zeros((0, len(AROUND), self.model.labels))
        # of each token: rows of both tables, class, whether it leads credentials, is a quote, is = or :
        self.flags = np.zeros((6, 0), dtype=np.int32)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > KEPT or self.chars > KEPT_CHARS:
            self.cleared()
        out = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if len(new := np.flatnonzero(out < 0)):
            self._add(list(dict.fromkeys(tokens[i] for i in new.tolist())))
            out[new] = [self.known[tokens[i]] for i in new.tolist()]
        return out

    def _add(self, tokens: list[str]) -> None:
        own_new: list[np.ndarray] = []
        near_new: list[np.ndarray] = []
        flags = []
        weights = self.tagger.weights
        for t in tokens:
            self.known[t] = len(self.known)
            self.chars += len(t)
            p = plain(t)
            key = p or f" {t}"
            row = self.own_rows.get(key)
            if row is None or p is None:
                own = own_features(t)
                group = _GROUPS.index(own[0])
                row = len(self.own_table) + len(own_new)
                own_new.append(weights([f"own {x}" for x in own]))
                if p:
                    self.own_rows[key] = row
            else:
                group = 6  # plain words are short ones
            if p and (low := t.lower()) not in self.words and not _LEXICON.search(low):
                near: tuple[str, ...] = ("groupshort",)
            else:
                near = tuple(x for x in near_features(t) if not x.startswith("word") or x[4:] in self.words)
            at = self.near_rows.get(near)
            if at is None:
                at = self.near_rows[near] = len(self.near_table) + len(near_new)
                near_new.append(np.stack([weights([f"{o} {x}" for x in near]) for o in AROUND]))
            flags.append((row, at, group, "credential" in near, t in _QUOTES, "=:".find(t) + 1 if len(t) == 1 else 0))
        if own_new:
            self.own_table = np.concatenate([self.own_table, np.stack(own_new)])
        if near_new:
            self.near_table = np.concatenate([self.near_table, np.stack(near_new)])
        if self.flags.shape[1] < len(self.known):  # room for twice as many
            self.flags = np.concatenate([self.flags, np.zeros((6, len(self.known)), dtype=np.int32)], axis=1)
        self.flags[:, len(self.known) - len(tokens) : len(self.known)] = np.array(flags, dtype=np.int32).T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores of each token's labels."""
        n = len(ids)
        own, near, group, cred, quote, mark = self.flags[:, ids]
        out = self.own_table[own]
        table = self.near_table[near]
        for k, o in enumerate(AROUND):
            if o < 0 and n > -o:
                out[-o:] += table[:o, k]
            elif 0 < o < n:
                out[:-o] += table[o:, k]
        close = np.zeros(n, dtype=np.int32)
        for k in range(1, 6):
            close[k:] |= cred[:-k]
        out += self.close[group, close, np.r_[0, quote[:-1]]]
        if n > 1:
            out[1:] += self.pairs[-1][group[1:], group[:-1]]
            out[:-1] += self.pairs[1][group[:-1], group[1:]]
        counts = Counter(dict(zip(_GROUPS, np.bincount(group, minlength=len(_GROUPS)).tolist(), strict=True)))
        counts["="], counts[":"], counts["q"] = int((mark == 1).sum()), int((mark == 2).sum()), int(quote.sum())
        return out + self.tagger.weights([f"text {x}" for x in text_features(counts)])


def stretches(model: LinearChainCRF, emit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [a, b) outside of which every token is outside on the best path.

    A run of other labels on the best path gains at least nothing over the same run outside. Each of its tokens gains at most
    the best of its scores plus the best of the moves into it, and leaving the run at most ``leave``.
    """
    stay = model.moves[OUTSIDE, OUTSIDE]
    inner = model.moves + model.barred
    enter = max(inner[a, b] for a in (BEGIN, INSIDE, OUTSIDE) for b in (BEGIN, INSIDE)) - stay
    enter = max(enter, model.first[BEGIN] - model.first[OUTSIDE])
    leave = max(max(model.moves[a, OUTSIDE] for a in (BEGIN, INSIDE)) - stay, model.last[:OUTSIDE].max() - model.last[OUTSIDE]) + 1e-6
    gain = emit[:, :OUTSIDE].max(axis=1) - emit[:, OUTSIDE] + enter
    ahead, back = gain.copy(), gain.copy()
    n = len(gain)
    for i in np.flatnonzero(gain > 0).tolist():
        if i + 1 < n and not ahead[i] > gain[i]:
            k = i + 1
            while k < n and ahead[k - 1] > 0:
                ahead[k] = gain[k] + ahead[k - 1]
                k += 1
    for i in np.flatnonzero(gain > 0)[::-1].tolist():
        if i and not back[i] > gain[i]:
            k = i - 1
            while k >= 0 and back[k + 1] > 0:
                back[k] = gain[k] + back[k + 1]
                k -= 1
    live = np.r_[False, ahead + back - gain >= -leave, False]
    edge = np.flatnonzero(live[1:] != live[:-1]).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def labels(tokens: Tokens, words: list[str]) -> list[tuple[int, int]]:
    """(place, label) of the tokens that are not outside on the best path."""
    if not words:
        return []
    model, emit = tokens.model, tokens.emissions(tokens.numbers(words))
    moves, out = model.moves + model.barred, []
    for a, b in stretches(model, emit):
        found = model.decode(emit[a:b], moves[OUTSIDE] if a else None, moves[:, OUTSIDE] if b < len(words) else None)
        out += [(a + k, x) for k, x in enumerate(found) if x != OUTSIDE]
    return out


def tag(tokens: Tokens, text: str) -> list[tuple[int, int]]:
    """Spans that the tagger finds: from each begin to its last inside."""
    found = labels(tokens, _TOKEN.findall(text))
    if not found:
        return []
    place = [m.span() for m in _TOKEN.finditer(text)]
    spans: list[tuple[int, int]] = []
    for i, x in found:
        if x == BEGIN:
            spans.append(place[i])
        else:
            spans[-1] = (spans[-1][0], place[i][1])
    return spans


def scan(tokens: Tokens, raw: bytes | None) -> tuple[str, list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """The text, its base spans, and all spans: tagged ones are added where no base span overlaps."""
    if not raw:
        return "", [], []
    text = raw.decode("utf-8")
    base = base_spans(text, raw)
    more = [(a, b, "tagged", a) for a, b in tag(tokens, text) if not any(x < b and a < y for x, y, *_ in base)]
    return text, base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


_SMALL, _LARGE, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _SMALL + _LARGE + _DIGITS


class Generator:
    """Texts with known secrets: prose and other harmless tokens, settings, quoted and bare credentials."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def some(self, chars: str, a: int, b: int) -> str:
        return "".join(self.r.choice(chars) for _ in range(self.r.randint(a, b)))

    def word(self, junk: bool = False) -> str:
        r = self.r
        w = "".join(r.choice(["th", "n", "r", "s", "t", "l", "d", "m", "ch", "sch", "b", "f", "g", "qu", "v", "p", "st", "tr", ""]) + r.choice(["e", "a", "i", "o", "u", "ie", "ei", "é", "ñó", "ä", "ou"]) + r.choice(["n", "r", "s", "", "", "ng", "tion", "ment", "lich", ""]) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6))))
        return r.choice([str, str, str, str, str.capitalize, str.upper])(w) + r.choice([""] * 12 + ["!!", "###", "***", "%%%", ",", ".", "?"] if not junk else ["", "###", "***", "%%%", "$$$", "&&&", "!!", ",&&&", ".%%%", "@@@", " |", "$", "&"])

    def value(self) -> str:
        """A credential that is told from other tokens by its shape alone."""
        r = self.r
        return r.choice([
            lambda: self.some(_ALNUM, 20, 48), lambda: self.some(_ALNUM + "+/", 28, 64) + "=" * r.randint(0, 2), lambda: self.some(_SMALL + _LARGE, 20, 44), lambda: self.some(_ALNUM + "-_", 24, 43),
            lambda: r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "rk_test_", "xoxb-", "xoxp-", "npm_", "hf_", "sk-", "pat_", "dop_v1_", "shpat_", "SG."]) + self.some(r.choice([_ALNUM, _LARGE, _SMALL + _DIGITS, _SMALL + _LARGE]), 16, 40),
            lambda: "eyJ" + self.some(_ALNUM, 12, 30) + "." + self.some(_ALNUM + "-_", 20, 50) + "." + self.some(_ALNUM + "-_", 20, 43), lambda: "AIza" + self.some(_ALNUM + "-_", 35, 35), lambda: self.some(_LARGE + _DIGITS, 24, 40),
        ])()

    def led(self) -> str:
        """A credential of any shape, told by what stands before it."""
        r = self.r
        plain = lambda: "".join(r.choice(["correct", "horse", "battery", "staple", "winter", "summer", "dragon", "monkey", "sun", "river", "apple", "tiger", "cloud", "green", "magic", "north"]) for _ in range(r.randint(1, 4)))
        return r.choice([
            self.value, self.value, lambda: self.some(_ALNUM, 8, 19), lambda: self.some(_SMALL, 8, 30), lambda: self.some(_LARGE, 8, 30), lambda: self.some(_DIGITS, 4, 16), lambda: self.some("0123456789abcdef", 8, 23), plain,
            lambda: plain() + self.some(_DIGITS, 1, 4), lambda: plain().capitalize() + self.some(_DIGITS, 1, 4) + r.choice("!@#$%&*?"), lambda: self.some(_ALNUM + "!@#$%&*", 8, 18), lambda: "-".join(self.some(_LARGE + _DIGITS, 4, 5) for _ in range(r.randint(3, 5))), lambda: self.some(_SMALL + _LARGE, 8, 24),
        ])()

    def harmless(self) -> str:
        r, w = self.r, lambda: re.sub(r"\W", "", self.word().lower())
        d = lambda a, b: self.some(_DIGITS, a, b)
        return r.choice([
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: d(8, 19), lambda: d(16, 16), lambda: f"{d(1, 3)}.{d(1, 3)}.{d(1, 3)}.{d(1, 3)}", lambda: f"+{d(1, 2)} ({d(3, 3)}) {d(3, 3)}-{d(4, 4)}", lambda: f"{w()}.{d(1, 2)}@mail{d(1, 1)}.example.com", lambda: f"{w()}.{w()}@{w()}.org",
            lambda: f"https://www.{w()}.com/{w()}/{d(1, 6)}.html?{w()}={d(1, 4)}", lambda: f"{w()}/{w()}/{d(1, 4)}.html", lambda: f"{w()}_{w()}_{d(1, 2)}", lambda: f"version {d(1, 1)}.{d(1, 2)}.{d(1, 2)}", lambda: f"v{d(1, 1)}.{d(1, 2)}-beta{d(1, 1)}", lambda: f"{w()}{d(1, 4)}", lambda: f"{w().upper()}-{d(3, 5)}",
            lambda: f"IMG_{d(8, 8)}.jpg", lambda: f"{w()}-{w()}-{w()}", lambda: f"ISBN {d(3, 3)}-{d(10, 10)}", lambda: f"{w()}{w().capitalize()}{w().capitalize()}", lambda: f"get{w().capitalize()}({w()}, {d(1, 3)})", lambda: f"{w()}={d(1, 4)}", lambda: f"{w()} = {w()}", lambda: f"{w()}: {w()}", lambda: f'"{w()}": "{w()}"', lambda: f"DE{d(20, 20)}",
            lambda: f"{d(1, 4)}{r.choice(['kg', 'km', 'px', 'ms', 'EUR'])}", lambda: f"{w()}{w()}{w()}{w()}", lambda: (w() + w() + w() + w()).upper() + "!!", lambda: "-".join(self.some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: ":".join(self.some("0123456789ABCDEF", 2, 2) for _ in range(6)), lambda: f"{d(2, 2)}:{d(2, 2)}:{d(2, 2)}",
            lambda: f"the {r.choice(['key', 'password', 'token', 'pass', 'secret', 'session', 'login', 'user', 'account', 'access'])} {r.choice(['is', 'was', 'of', 'to', 'and', 'for', 'must be'])} {w()}", lambda: f"{r.choice(['key', 'pass', 'token', 'session'])} {w()} {w()}", lambda: f"Licensed under CC BY-NC {d(1, 1)}.0.", lambda: f"{r.choice(['author', 'title', 'name', 'date', 'note', 'subject', 'city', 'page', 'id', 'from'])}: {self.word()} {w()}", lambda: f"| {w()} | {w()} |", lambda: f"#{self.some('0123456789abcdef', 6, 6)}",
        ])()

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        """A text and the spans of its secrets."""
        r, text, spans = self.r, "", []

        def put(lead: str, values: list[str], close: str = "") -> None:
            nonlocal text
            text += lead
            for k, v in enumerate(values):
                text += "\n" * (k > 0)
                if not k:
                    spans.append((len(text), 0))
                text += v
            spans[-1] = (spans[-1][0], len(text))
            text += close

        junk = r.random() < 0.25
        for _ in range(r.choice((1, 1, 2, 3, 5))):
            for _ in range(r.choice((0, 2, 6, 12)) if not junk else r.randint(3, 20)):
                text += self.word(junk) + r.choice([" "] * 9 + ["\n"])
            kind = r.random() if not junk else max(0.3, r.random())
            if kind < 0.35:
                name = r.choice(["key", "auth", "credential", "credentials", "access_key", "private_key", "pwd", "pass", "PASS", "client_key", "aws_key", "signature", "cookie", "session", "session_id", "db_pass", "login", "PIN", "passcode", "passphrase", "auth-key", "encryption_key", "signing.key", "license key", "Key", "x-api-auth", "bot_auth", "ssh key", "master key", "user_pwd", "otp", "root_pw", "account_key"])
                q = r.choice(["", "", '"', "'"])
                put(r.choice(["", q]) * bool(q) + name + (q if r.random() < 0.5 else "") + r.choice([": ", ":", "=", " = ", " : ", " => ", " is "]) + q, [self.led()], q + r.choice(["", "", ",", ";"]))
            elif kind < 0.45:
                put(r.choice(["Authorization: Bearer ", "authorization: Basic ", "bearer ", "Bearer ", "Authorization: ", "-H 'Authorization: Bearer ", "X-Auth: ", "Cookie: session="]), [self.value()])
            elif kind < 0.62:
                q = r.choice(["", "", '"', "'", "`", "("])
                put(q, [self.value()], q.replace("(", ")") + r.choice(["", "", ".", ","]))
            elif kind < 0.66:
                put(r.choice(["-----BEGIN PRIVATE KEY-----\n", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN OPENSSH PRIVATE KEY-----\n"]), [self.some(_ALNUM + "+/", 64, 64) for _ in range(r.randint(2, 5))])
            else:
                for _ in range(r.randint(1, 4)):
                    text += self.harmless() + " "
            text += r.choice([" ", " ", "\n"])
        return text, spans


def labelled(n: int = SAMPLE, seed: int = 20) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated texts and their secrets' spans."""
    made = Generator(seed)
    return [made.text() for _ in range(n)]


@functools.cache
def trained(n: int = SAMPLE, seed: int = 20) -> Tagger:
    """The tagger; the same for the same arguments. Features seen in fewer than SEEN tokens are left out."""
    number: dict[str, int] = {}
    found = []  # a sequence's features by number as soon as it is made, for the driver's sake
    for text, spans in labelled(n, seed):
        tags, words = [], []
        for m in _TOKEN.finditer(text):
            inside = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1]), None)
            words.append(m.group())
            tags.append(OUTSIDE if inside is None else BEGIN if inside[0] == m.start() else INSIDE)
        if words:
            rows = feature_names(words)
            out = np.zeros((len(rows), max(map(len, rows))), dtype=np.int32)
            for i, row in enumerate(rows):
                out[i, : len(row)] = [number.setdefault(x, len(number) + 1) for x in row]
            found.append((out, np.array(tags)))
    seen = np.zeros(len(number) + 1, dtype=np.int64)
    for out, _ in found:
        seen += np.bincount(out.ravel(), minlength=len(seen))
    kept = sorted(x for x, k in number.items() if seen[k] >= SEEN)
    names = {x: k for k, x in enumerate(kept, 1)}
    to = np.zeros(len(number) + 1, dtype=np.int32)
    for x, k in names.items():
        to[number[x]] = k
    model = LinearChainCRF(3, len(names) + 1, forbidden=((OUTSIDE, INSIDE),), not_first=(INSIDE,))
    padded = [(to[out], tags) for out, tags in found]
    return Tagger(model.fit(padded, epochs=4), names)


@functools.lru_cache(maxsize=2)
def _worker_tokens(n: int, seed: int) -> list[Tokens]:
    return []


def tokens_of(tagger: Tagger, sample: int) -> Tokens:
    """This worker's table of tokens, which serves all its tasks."""
    kept = _worker_tokens(sample, 20)
    if not kept:
        kept.append(Tokens(tagger))
    return kept[0]


def query(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    A span is a whole match, from the keyword on for ``assign``. A null or empty text has none. Rows that repeat a
    doc_id, or have none, are scanned each. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(model.value, sample)
        for b in slices(batches):
            counts, digest, spans = [[], [], []], [], []
            for raw in byte_rows(b.column(1)):
                _, base, every = scan(tokens, raw)
                for k, kind in enumerate(KINDS[:3]):
                    counts[k].append(sum(s[2] == kind for s in base))
                said = ",".join(f"{kind}:{x}:{y}" for x, y, kind, _ in base)
                digest.append(hashlib.sha256(said.encode()).hexdigest())
                spans.append(",".join(f"{kind}:{x}:{y}" for x, y, kind, _ in every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with each secret's value replaced by MASK; all rows and columns stay, n_chars follows the text.

    Of an assignment the keyword stays. Values that overlap are masked as one. Texts without secrets, null and empty
    texts are returned as they are. Rows that repeat a doc_id are masked each; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(model.value, sample)
        for b in slices(batches):
            out = []
            for raw in byte_rows(b.column(at)):
                text, _, every = scan(tokens, raw)
                if every:
                    done, kept = 0, []
                    for x, y in sorted((s[3], s[1]) for s in every):
                        if x >= done:
                            kept += [text[done:x], MASK]
                        done = max(done, y)
                    raw = "".join([*kept, text[done:]]).encode()
                out.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
