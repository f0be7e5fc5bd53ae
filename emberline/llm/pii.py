"""Personal data by base recognisers and a semi-Markov conditional random field.

The base recognisers are exact patterns for e-mail addresses, IP addresses, card numbers and phone numbers. Their matches
always stand. The random field finds what the patterns lose, as two neighbours read as one number, a phone
number without a country code, or a secret. It works on *zones*: stretches of text around digits and at signs. A zone is cut into
tokens; candidate segments are stretches of signs of numbers with at most ``MOST_DIGITS`` digits, stretches of signs of addresses around one at
sign, both of at most ``MOST_SIGNS`` signs, and whole runs of signs of secrets, however long. Each has features of the
whole stretch: shape, number of digits, checksum, octets, what stands on either side and before it.
Segments outside entities are single tokens of score 0. Dynamic programming over the zone chooses boundaries and types
together, with weights for neighbouring types; forward and backward sums give each chosen segment's probability.

Weights are learned by maximum likelihood on zones made by rule from a fixed seed, and on at most ``FIT_ZONES`` zones of
the corpus, those of the documents whose ids hash lowest, where base matches are the truth. A segment counts if it is on
the best path, its probability reaches ``CONFIDENCE`` and it overlaps no base match.

Cases: a null or empty text has no spans; positions count code points, ends are exclusive; base matches of different kinds
may overlap, and redaction joins them under the first one's kind; repeated rows give repeated rows; an empty table gives
no rows and a model of the made zones alone; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, with_columns

#: The base patterns' kinds, and with them those that only the field knows.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Digits of the longest card number; signs of the longest deliverable e-mail address.
MOST_DIGITS, MOST_SIGNS = 19, 254
FIT_ZONES, MADE_ZONES, PASSES = 500, 2_000, 5
#: Of one document at most so many, so that no long one fills them all.
ZONES_A_DOCUMENT = 10
CONFIDENCE = 0.9

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))

# The base patterns. Those begun by a look back only skip starts that cannot match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)
_ANCHOR = re.compile("[0-9@]")
_CHUNK = re.compile(r"\S+")
_GAP = re.compile(" {1,2}(?! )")
_RUN = re.compile("[A-Za-z0-9][A-Za-z0-9_+/-]{15,}={0,2}")
_SECRET_CUE = re.compile(r"(?i)(token|secret|password|passwd|pwd|key|bearer|auth|credentials?)[\W_]{0,6}$")
_NUMBER_SIGNS, _MAIL_SIGNS = frozenset(" ()+-./"), frozenset("@._%+-")
_NEXT = re.compile("[ -]{0,2}([+(]?)([0-9]{0,9})")
_CUES = re.compile(r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|pay|ip|host|addr|server|token|key|passw|version|v|page|no|date)\W*$")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, in order."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(small, m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(text: str) -> str:
    """Letters as ``a``, and digit runs as their length (9 for longer), other signs as they are; at most 24 signs."""
    out = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), re.sub(r"[^\W\d_]+", "a", text[:96]))
    return out[:24]


@dataclass
class Segment:
    first: int
    last: int  # token after the segment
    start: int
    end: int
    features: list[str]


def segments(text: str, start: int, end: int) -> tuple[int, list[Segment]]:
    """Number of tokens of a zone of ``text``, and its candidate segments."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    cue = _CUES.search(text, max(0, start - 16), start)
    heads = [text[a] for a, _ in tokens]
    digit = [h.isascii() and h.isdigit() for h in heads]
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (digit[i] or heads[i] in "+(" or heads[i].isalpha()):
            continue
        n_digits, ats, spaces = 0, 0, 0
        mail = True
        number = not heads[i].isalpha() and not (i > 1 and heads[i - 1] == "." and digit[i - 2])  # none begins inside a dotted number
        before = text[a - 1] if a else " "
        for j in range(i, len(tokens)):
            b = tokens[j][1]
            if digit[j]:
                n_digits += b - tokens[j][0]
            ats += heads[j] == "@"
            spaces += heads[j] == " "
            inside = digit[j] or heads[j].isalpha()
            mail = mail and ats <= 1 and (inside or heads[j] in _MAIL_SIGNS)
            number = number and not ats and n_digits <= MOST_DIGITS and (digit[j] or heads[j] in _NUMBER_SIGNS)
            if b - a > MOST_SIGNS or not (mail or number):
                break
            if not inside or not (mail and ats or number and n_digits >= 4 and digit[j]):
                continue
            own, after = text[a:b], text[b:b + 1] or " "
            features = ["shape=" + shape(own), f"digits={min(n_digits, 20)}", f"ats={ats}", f"spaces={min(spaces, 4)}",
                        "left=" + ("a" if before.isalnum() else "s" if before.isspace() else before),
                        "right=" + ("a" if after.isalnum() else "s" if after.isspace() else after),
                        "glued" if before.isalnum() or after.isalnum() or before in "_%+-" and ats else "free",
                        "cue=" + (cue[1].lower() if cue and i == 0 else "")]
            if not ats:
                digits = digits_of(own)
                if set(own) <= set("0123456789 -") and 14 <= n_digits <= 19:
                    features.append("card:" + ("valid" if luhn(digits) else "invalid"))
                if own.count(".") == 3 and set(own) <= set("0123456789."):
                    features.append("ip:" + ("valid" if all(map(small, own.split("."))) else "invalid"))
                if set(own) <= set("0123456789 ().+-"):
                    groups = re.findall("[0-9]+", own)
                    features.append(("plus:" if own[0] == "+" else "paren:" if own[0] == "(" else "groups:")
                                    + "-".join(str(min(len(g), 5)) for g in groups[-4:]))
                    sign, follows = _NEXT.match(text, b).groups()
                    features.append(f"next={sign}{min(len(follows), 9)}")
                    features.append(f"form={own[0] if own[0] in '+(' else '9'}:{'trunk' if '(0)' in own else ''}:{10 <= n_digits <= 15}:{min(max(map(len, groups)), 5)}:{sign}{min(len(follows), 5)}")
                    features.append("phone:" + ("ok" if 10 <= n_digits <= 15 else "odd") + ("" if own.count("(") == own.count(")") else "!"))
            else:
                local, _, domain = own.partition("@")
                features.append("mail:" + ("ok" if local and set(local) <= LOCAL and DOMAIN.fullmatch(domain) else "odd"))
                features.append("ends:" + ("a" if heads[j].isalpha() else "9"))
            out.append(Segment(i, j + 1, a, b, features))
    first, last = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
    for a, b in secret_runs(text, start, end):
        if a in first and b in last:
            out.append(Segment(first[a], last[b], a, b, secret_features(text, a, b)))
    return len(tokens), out


def secret_runs(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Whole runs of signs of secrets that hold letters and digits."""
    for m in _RUN.finditer(text, start, end):
        if any(x.isdigit() for x in m[0]) and any(x.isalpha() for x in m[0]):
            yield m.span()


def secret_features(text: str, a: int, b: int) -> list[str]:
    own, before = text[a:b], text[a - 1] if a else " "
    cue = _SECRET_CUE.search(text, max(0, a - 24), a)
    signs = "hex" if set(own) <= set("0123456789abcdef") or set(own) <= set("0123456789ABCDEF") else "alnum" if own.isalnum() else "mixed"
    switches = sum(x.isdigit() != y.isdigit() for x, y in zip(own, own[1:]))
    return ["secret", "secret:cue=" + (cue[1].lower() if cue else ""), "secret:" + ("cued" if cue else "plain"), "secret:signs=" + signs,
            f"secret:length={min(len(own) // 8, 9)}", f"secret:distinct={min(len(set(own)) // 4, 8)}", f"secret:switches={min(8 * switches // len(own), 8)}",
            "secret:left=" + ("a" if before.isalnum() else "s" if before.isspace() else before),
            "secret:right=" + ("a" if text[b:b + 1].isalnum() else "s" if not text[b:b + 1].strip() else text[b])]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis)) + top


@dataclass
class SemiMarkov:
    """Weights of features by type, and of pairs of neighbouring types; type 0 is outside."""

    number: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def scores(self, some: list[Segment]) -> np.ndarray:
        """Scores of segments by entity type."""
        return np.stack([self.weight[[n for f in s.features if (n := self.number.get(f)) is not None]].sum(axis=0) for s in some]
                        ) if some else np.zeros((0, len(KINDS)))

    def sums(self, n: int, some: list[Segment], score: np.ndarray):
        """Log sums over all ways to cut the zone: up to each place by last type, from each place on by the type before."""
        k = len(KINDS) + 1
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for s, seg in enumerate(some):
            by_end[seg.last].append(s)
            by_start[seg.first].append(s)
        first = np.array([seg.first for seg in some], dtype=np.int64)
        last = np.array([seg.last for seg in some], dtype=np.int64)
        low = -1e9
        alpha, into = np.full((n + 1, k), low), np.full((n + 1, k), low)
        alpha[0, 0] = 0.0
        for j in range(n + 1):
            if j:
                alpha[j, 0] = into[j - 1, 0]
                if by_end[j]:
                    own = by_end[j]
                    alpha[j, 1:] = _sum(into[first[own], 1:] + score[own], 0)
            into[j] = _sum(alpha[j][:, None] + self.pair, 0)
        beta, onward = np.full((n + 1, k), low), np.full((n + 1, k), low)
        beta[n] = 0.0
        for i in range(n - 1, -1, -1):
            onward[i, 0] = beta[i + 1, 0]
            if by_start[i]:
                own = by_start[i]
                onward[i, 1:] = _sum(score[own] + beta[last[own], 1:], 0)
            beta[i] = _sum(self.pair + onward[i][None, :], 1)
        return alpha, into, beta, onward, first, last, _sum(alpha[n], 0)

    def best(self, n: int, some: list[Segment], score: np.ndarray) -> list[tuple[int, int]]:
        """(segment number, type) of the entities on the best path."""
        k = len(KINDS) + 1
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for s, seg in enumerate(some):
            by_end[seg.last].append(s)
        value, step = np.full((n + 1, k), -1e9), {}
        value[0, 0] = 0.0
        for j in range(1, n + 1):
            through = value[j - 1] + self.pair[:, 0]
            value[j, 0], step[j, 0] = through.max(), (None, int(through.argmax()))
            for s in by_end[j]:
                through = value[some[s].first][:, None] + self.pair[:, 1:]
                total = through.max(axis=0) + score[s]
                for t in np.flatnonzero(total > value[j, 1:]):
                    value[j, t + 1], step[j, t + 1] = total[t], (s, int(through[:, t].argmax()))
        out, j, t = [], n, int(value[n].argmax())
        while j:
            s, before = step[j, t]
            if s is not None:
                out.append((s, t))
            j, t = (j - 1 if s is None else some[s].first), before
        return out[::-1]

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the entities of a zone that are likely enough."""
        n, some = segments(text, start, end)
        if not some:
            return []
        score = self.scores(some)
        chosen = self.best(n, some, score)
        if not chosen:
            return []
        alpha, into, beta, _, first, last, whole = self.sums(n, some, score)
        return [(some[s].start, t - 1, some[s].end) for s, t in chosen
                if np.exp(into[first[s], t] + score[s, t - 1] + beta[last[s], t] - whole) >= CONFIDENCE]

    def fit(self, zones: list[tuple[str, int, int, list[tuple[int, int, int]]]], passes: int = PASSES) -> SemiMarkov:
        """Maximum likelihood by AdaGrad on (text, zone start, zone end, true (start, kind, end))."""
        made = [(n, some, {(a, b): k for a, k, b in truth}) for text, start, end, truth in zones
                for n, some in [segments(text, start, end)] if some]
        for _, some, _ in made:
            for seg in some:
                for f in seg.features:
                    self.number.setdefault(f, len(self.number))
        self.weight = np.zeros((len(self.number), len(KINDS)))
        index = [[np.array([self.number[f] for f in seg.features]) for seg in some] for _, some, _ in made]
        seen, seen_pair = np.full_like(self.weight, 1e-6), np.full_like(self.pair, 1e-6)
        rng = random.Random(7)
        order = list(range(len(made)))
        for _ in range(passes):
            rng.shuffle(order)
            for z in order:
                n, some, truth = made[z]
                score = np.stack([self.weight[f].sum(axis=0) for f in index[z]])
                alpha, into, beta, onward, first, last, whole = self.sums(n, some, score)
                gradient = -np.exp(into[first, 1:] + score + beta[last, 1:] - whole)
                pair = -np.exp(alpha[:n, :, None] + self.pair[None] + onward[:n, None, :] - whole).sum(axis=0)
                place, before = 0, 0
                true = sorted((seg.first, s, truth[seg.start, seg.end]) for s, seg in enumerate(some) if (seg.start, seg.end) in truth)
                for begin, s, kind in true:
                    gradient[s, kind] += 1.0
                for begin, s, kind in true:  # the true path's pairs, outside tokens between entities included
                    while place < begin:
                        pair[before, 0] += 1.0
                        before, place = 0, place + 1
                    pair[before, kind + 1] += 1.0
                    before, place = kind + 1, some[s].last
                while place < n:
                    pair[before, 0] += 1.0
                    before, place = 0, place + 1
                total = np.zeros_like(self.weight)
                flat = np.concatenate(index[z])
                np.add.at(total, flat, np.repeat(gradient, [len(f) for f in index[z]], axis=0))
                rows = np.unique(flat)
                step = total[rows] - 1e-4 * self.weight[rows]
                seen[rows] += step ** 2
                self.weight[rows] += 0.3 * step / np.sqrt(seen[rows])
                seen_pair += pair ** 2
                self.pair += 0.05 * pair / np.sqrt(seen_pair)
        return self


def made_zones(n: int = MADE_ZONES, seed: int = 11) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """Zones by rule: each kind in its usual forms, alone or side by side, and numbers that are none of them."""
    rng = random.Random(seed)
    syllables = "an the er on in re ou ti en le sch ment ado ción".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            digits = rng.choice("3456") + number(rng.choice((13, 14, 15, 15, 15)))
            if luhn(digits) == valid:
                sep = rng.choice(("", "", " ", "-"))
                return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {number(3)} {number(7)}",
                           f"+{number(2)}{number(9)}", f"+1-{a}-{b}-{c}", f"+{number(2)} ({number(2)}) {number(4)} {number(4)}"))

    def email() -> str:
        return (rng.choice((word(), f"{word()}.{number(2)}", f"{word()}_{word()}", f"{word()}+{word()}")).replace("ó", "o") + "@"
                + rng.choice((f"mail{number(1)}.", "")) + word().replace("ó", "o") + rng.choice((".com", ".org", ".co.uk", ".de")))

    def ip(valid: bool) -> str:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        if not valid:
            parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts)

    def far_phone() -> str:
        while True:
            sep = rng.choice((" ", " ", "-"))
            groups = sep.join(number(rng.choice((2, 3, 4)) if rng.random() < 0.6 else 2) for _ in range(rng.choice((2, 2, 3, 4))))
            own = f"+{number(2)} (0){rng.choice(('', ' '))}{number(rng.choice((1, 2, 2, 3)))}{sep}{groups}"
            if 10 <= len(digits_of(own)) <= 15:
                return own

    def code() -> str:
        signs = rng.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
                            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
        body = "".join(rng.choice(signs) for _ in range(rng.choice((16, 18, 20, 24, 32, 40, 40, 64))))
        return rng.choice("abcdefABCDEF" if len(signs) > 16 else signs[10:]) + body[1:-1] + number(1)

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after it."""
        name = rng.choice(("token", "api_key", "apikey", "secret", "secret_key", "password", "passwd", "pwd", "access_token", "auth", "key", "credential"))
        name = rng.choice((name, name, name.upper(), name.title()))
        left, right = rng.choice((('="', '"'), (' = "', '"'), (": ", ""), ("=", ""), (": '", "'"), (" = '", "'"), ('": "', '"'), (" ", "")))
        return rng.choice(((name + left, code(), right), ("Bearer ", code(), "")))

    def nothing() -> str:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 18, 32, 40))))
        return rng.choice((number(rng.randint(1, 9)), number(rng.randint(20, 24)), f"{number(4)}-{number(2)}-{number(2)}", f"{number(1)}.{number(1)}.{number(2)}",
                           f"${number(3)}.{number(2)}", f"{number(2)}:{number(2)}", f'"{hexes}"', f"commit {code()}", f"sha1={code()}", f"md5: {code()}", f"/{word()}/{code()}",
                           "-".join(hexes[i:i + 4] for i in range(0, 16, 4)), code(), card(False), ip(False),
                           f"{word()}{number(3)}", f"@{word()}", f"{number(3)} {number(3)}", f"{number(4)} {number(4)}", f"{word()}@", hexes))

    out = []
    for _ in range(n):
        text, truth = rng.choice(("", word() + " ", word() + ". ")), []
        for i in range(rng.choice((1, 1, 1, 2, 2, 3))):
            kind = rng.choice((0, 1, 2, 3, 4, None, None))
            before, after = "", ""
            if kind == 4:
                before, own, after = secret()
            elif kind == 3 and rng.random() < 0.4:
                own = far_phone()
            else:
                own = (email, lambda: ip(True), lambda: card(True), phone)[kind]() if kind is not None else nothing()
            text += (" " if i else "") + before
            if kind is not None:
                truth.append((len(text), kind, len(text) + len(own)))
            text += own + after
        tail = rng.choice(("", "", ".", ",", "###", "$$$", "!!"))
        text += tail + rng.choice(("", " " + word()))
        out += split_zones(text, truth)
    return out


def split_zones(text: str, truth: list[tuple[int, int, int]]) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """The zones of a text, each with the entities in it."""
    return [(text, start, end, [t for t in truth if start <= t[0] and t[2] <= end]) for start, end in zones(text)]


def corpus_zones(texts: list[str]) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """Zones of texts with the base matches in them as truth; zones where base matches overlap teach nothing."""
    out = []
    for text in texts:
        found = base(text)
        for start, end in zones(text):
            truth = [(a, k, b) for a, k, b in found if start <= a and b <= end]
            if all(x[2] <= y[0] for x, y in zip(truth, truth[1:])) and (truth or not _DIGIT.search(text, start, end)) \
                    and not any(True for _ in secret_runs(text, start, end)):  # the patterns don't know secrets
                around = text[max(0, start - 16):end + 1]
                move = max(0, start - 16)
                out.append((around, start - move, end - move, [(a - move, k, b - move) for a, k, b in truth]))
    return out


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Runs of chunks without white space, one or two spaces apart, that each hold a digit or an at sign."""
    done = 0
    while anchor := _ANCHOR.search(text, done):
        start, end = anchor.start(), _CHUNK.match(text, anchor.start()).end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while gap := _GAP.match(text, end):
            chunk = _CHUNK.match(text, gap.end())
            if not chunk or not _ANCHOR.search(chunk[0]):
                break
            end = chunk.end()
        yield start, end
        done = end


def find_all(text: str | None, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base matches, and base matches with what the model adds, as (start, kind number, end) in order."""
    if not text:
        return [], []
    found = base(text)
    extra = [(a, k, b) for start, end in zones(text) for a, k, b in model.decode(text, start, end)
             if not any(a < d and c < b for c, _, d in found)]
    return found, sorted(found + extra)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> SemiMarkov:
    """A model from made zones and a bounded sample of the corpus; fitted in one task."""
    spark = bounded(docs.sparkSession)
    own = docs.select(F.xxhash64(F.col(f"`{doc_id}`")).alias("h"), F.col(f"`{text}`").alias("text")).where(F.rlike("text", F.lit("[0-9@]")))
    n = docs.count()
    share = min(1.0, 40 * FIT_ZONES / max(n, 1))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, zone) for h, t in zip(*[c.to_pylist() for c in batch.columns]) for zone in corpus_zones([t])[:ZONES_A_DOCUMENT]]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()),
                                              pa.array([pickle.dumps(z) for _, z in rows], pa.binary())], names=["h", "zone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        model = SemiMarkov().fit(made_zones() + [pickle.loads(z) for _, z in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    some = own.where(F.pmod("h", F.lit(1 << 32)) <= int(share * (1 << 32))).mapInArrow(few, "h long, zone binary")
    picked = some.orderBy("h", "zone").limit(FIT_ZONES).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(picked[0]) if picked else SemiMarkov().fit(made_zones())


def find(docs: DataFrame, model: SemiMarkov, text: str = "text", redacted: str | None = None) -> DataFrame:
    """Adds ``base_spans`` and ``spans`` (kind, start, end by start); with ``redacted``, also the text with spans masked."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value
        kind = SPANS.elementType.fieldNames()

        def run(texts: pa.Array):
            firsts, alls, masked = [], [], []
            for t in texts.to_pylist():
                first, every = find_all(t, own)
                firsts.append([dict(zip(kind, (KINDS[k], a, b))) for a, k, b in first])
                alls.append([dict(zip(kind, (KINDS[k], a, b))) for a, k, b in every])
                masked.append(mask(t, every))
            made = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            out = [pa.array(firsts, made), pa.array(alls, made)]
            return out + [pa.array(masked, pa.string())] if redacted else out

        return run

    adds = [T.StructField("base_spans", SPANS), T.StructField("spans", SPANS)]
    if redacted:
        adds.append(T.StructField(redacted, T.StringType()))
    return with_columns(docs, [text], adds, start)


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    if not spans:
        return text
    parts, done = [], 0
    for a, k, b in spans:
        if a >= done or not parts:
            parts += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join(parts) + text[done:]
