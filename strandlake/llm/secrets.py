r"""Secret scan by a linear-chain conditional random field.

Three patterns give the base spans (assignments, access keys, long hexadecimal runs). A CRF over tokens adds spans of
kind ``crf``: each token is tagged begin, inside or outside from its shape, the words next to it and features of the
whole file; Viterbi decodes the tags. Weights are fitted here, on files that a seeded generator writes (``written_files``: prose,
settings, code and logs with secrets and with what looks like them; tokens, tags and features are read off the files), or on
any given ones (``sequence``, ``fit``).

Decoding covers every token of whole texts, yet most need no work: a token whose outside score leads by more than any
neighbours, features of the text and transitions can make up for is outside in the best path (swapping it to outside
raises the score of any path), so the chain falls apart into short runs around the other tokens, each decoded exactly.

Null texts count as empty. A text without spans has the digest of the empty string. A CRF span within one base span is left
out; one that reaches beyond is added, so that no rest of a longer secret remains; base spans stay. Texts of any length are
scanned whole. Repeated rows are scanned alike, and an empty table gives none. Further columns are not looked at by the scan and
kept by ``redact_documents``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, rows_of, values_of

# The base patterns, and the least length of what must be long enough.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "crf")
# Words that stand near secrets.
CUES = frozenset(
    "password passwd passphrase pass pwd secret token key apikey api_key auth authorization bearer basic credential credentials private access_key secret_key access_token auth_token private_key "
    "secret_access_key aws_secret_access_key client_secret signing_key webhook login".split()
)

TOKEN = re.compile(r"[A-Za-z0-9+/_.=\-]+|[^\sA-Za-z0-9+/_.=\-]")
TAGS = ("O", "B", "I")
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(k in low for k in ("password", "passwd", "secret", "token", "key")):
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def entropy(word: str) -> float:
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in (word.count(x) for x in set(word)))


UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
DATED = re.compile(r"(?:19|20)\d\d[-_/.]?[01]\d[-_/.]?[0-3]\d|\d\d?[.:]\d\d")
WORDY = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}(?![a-z0-9])")
LEAD = re.compile(r"([A-Za-z]{2,6})(?:[-_][A-Za-z0-9]{2,6})?[-_](?=[A-Za-z0-9]{12})")


def shape(word: str) -> tuple[str, ...]:
    """Features of a token alone. A plain word has one."""
    core = word.strip(".=-_/+")
    if not core or not any(c.isalnum() for c in core):
        return ("joint" if word in ("=", ":", '"', "'") else "mark",)
    if core.lower() in CUES:
        return ("cue",)
    if core.isalpha() and (core.islower() or core.istitle() or core.isupper()) or not core.isascii():
        return ("word",)
    digits = sum(c.isdigit() for c in core)
    upper, lower = sum(c.isupper() for c in core), sum(c.islower() for c in core)
    if digits == len(core.replace(".", "").replace("-", "").replace("/", "")):
        return ("number", "long number" if len(core) >= 12 else "short number")
    n = len(core)
    words = sum(len(m.group()) for m in WORDY.finditer(core))
    turns = sum((a.isdigit(), a.isupper(), a.islower()) != (b.isdigit(), b.isupper(), b.islower()) for a, b in zip(core, core[1:], strict=False))
    out = [
        "other",
        f"length {min(8, n // 6)}",
        f"kinds {(digits > 0) + (upper > 0) + (lower > 0)}",
        f"entropy {min(9, int(2 * entropy(core)))}",
        f"digits {min(4, 8 * digits // n)}",
        f"turns {min(5, 8 * turns // n)}",
        f"words {min(5, 6 * words // n)}",
        f"length and words {min(4, n // 8)} {min(3, 4 * words // n)}",
        "dotted" if "." in core else "solid",
        f"slashes {min(2, core.count('/'))}",
        "joined" if "-" in core or "_" in core else "single",
    ]
    if UUID.fullmatch(core):
        out.append("uuid")
    if DATED.search(core):
        out.append("dated")
    if word.startswith("//") or core.startswith("www."):
        out.append("address")
    if m := LEAD.match(core):
        out += ["led", "lead " + m[1].lower()]
    if not lower and all(c in "0123456789ABCDEF" for c in core):
        out.append("upper hex")
    if word.endswith("="):
        out.append("padded")
    return tuple(out)


def group(word: str) -> str:
    """What neighbours see of a token besides the word itself."""
    first = shape(word)[0]
    return word if word in ("=", ":", "@", "/", "#", '"') else first


def features_of_text(text: str) -> tuple[str, ...]:
    """Of the whole file: what kind it is, and whether it speaks of secrets."""
    lines = text.count("\n") + 1
    settings = text.count("=") + text.count(": ")
    kind = "code" if text.count("{") + text.count(";") >= max(2, lines / 4) else "settings" if settings >= max(1, lines / 2) else "prose"
    low = text.lower()
    return (kind, "short" if len(text) < 400 else "long", "speaks of secrets" if any(w in low for w in ("secret", "credential", "password", "token", "private", "api_key", "apikey")) else "silent")


def names_of(words: Sequence[str], text: tuple[str, ...]) -> list[list[str]]:
    """Features of each token. Neighbours and the whole text bear on tokens that aren't plain words or marks."""
    shapes = [shape(w) for w in words]
    groups = ["edge", "edge", "edge", *map(group, words), "edge", "edge"]
    lows = ["", "", "", *(w.lower() if len(w) <= 24 else "" for w in words), "", ""]
    out = []
    for k, own in enumerate(shapes):
        row = ["own " + f for f in own]
        if own[0] in ("other", "number"):
            row += [f"{own[0]} {at} {groups[k + 3 + by]}" for at, by in (("before", -1), ("before that", -2), ("before all", -3), ("after", 1))]
            row += [f"{own[0]} word {by} {lows[k + 3 + by]}" for by in (-3, -2, -1, 1)]
            row += [f"{own[0]} text {x}" for x in text] + [f"{own[1]} text {text[0]}"]
        out.append(row)
    return out


@dataclass
class Model:
    """Scores by (feature, tag), and of tag after tag."""

    weights: dict[str, list[float]]
    steps: list[list[float]]

    def __post_init__(self) -> None:
        t = self.steps
        #: The most that transitions can do against outside, at either end of a text or within it.
        self.reach = max(
            0.0,
            *(t[p][x] + t[x][n] - t[p][0] - t[0][n] for p in range(3) for n in range(3) for x in (1, 2)),
            *(t[p][x] - t[p][0] for p in range(3) for x in (1, 2)),
            *(t[x][n] - t[0][n] for n in range(3) for x in (1, 2)),
        )

    def sums(self, features: Sequence[str]) -> list[float]:
        out = [0.0, 0.0, 0.0]
        for f in features:
            for k, v in enumerate(self.weights.get(f, (0.0, 0.0, 0.0))):
                out[k] += v
        return out

    def is_outside(self, word: str) -> bool:
        """Whether the best path is outside at this token, whatever stands around it."""
        own = shape(word)
        if own[0] in ("other", "number"):
            return False
        o, b, i = self.sums(["own " + f for f in own])
        return o - max(b, i) > self.reach

    def scores(self, words: Sequence[str], text: tuple[str, ...]) -> list[list[float]]:
        return [self.sums(row) for row in names_of(words, text)]

    def viterbi(self, scores: list[list[float]]) -> list[int]:
        best, back = scores[0][:], []
        for row in scores[1:]:
            came = [max(range(3), key=lambda p, x=x: best[p] + self.steps[p][x]) for x in range(3)]
            best = [best[came[x]] + self.steps[came[x]][x] + row[x] for x in range(3)]
            back.append(came)
        path = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


Labelled = tuple[str, list[tuple[int, int]]]
LOW, UP, NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Words that name things in files; what stands before secrets there that the base patterns don't know; and leads of issued keys.
THINGS = "user order item page file data model index value count config server client build test release node host image table event report status session request query cache batch worker color title label".split()
NAMED_SECRETS = "aws_secret_access_key secret_access_key private_key signing_key encryption_key access_key master_key DB_PASS db_pass pwd passphrase auth_key ENCRYPTION_KEY SIGNING_KEY PRIVATE_KEY webhook_key credentials".split()
OPENERS, CLOSERS = ("we use", "use", "with", "push with", "commit", "see", "of the", "and", "set", "my"), ("here", "and", "for", "as a", "in the", "now", "to")
LEADS = "ghp_ gho_ sk- sk_live_ rk_live_ pk_live_ xoxb- glpat- npm_ hf_ SG. key- pat_ dop_v1_ shpat_".split()


class Writer:
    """A seeded generator of files with and without secrets."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def upto(self, n: int) -> int:
        return int(self.rng.random() * n)

    def pick(self, xs):  # noqa: ANN001, ANN201
        return xs[self.upto(len(xs))]

    def draw(self, alphabet: str, least: int, most: int | None = None) -> str:
        n = least if most is None else least + self.upto(most - least + 1)
        return "".join(self.rng.choices(alphabet, k=n))

    def word(self) -> str:
        w = "".join(self.pick("b c d f g l m n p r s t th st ch".split()) + self.pick("aeiou") for _ in range(1 + self.upto(4))) + self.pick(["", "n", "r", "s", "t"])
        return self.pick([w, w, w, w.title(), w.upper()])

    def name(self) -> str:
        a, b = self.pick(THINGS), self.pick(THINGS)
        return self.pick([f"{a}_{b}", f"{a}{b.title()}", f"{a.title()}{b.title()}", f"{a}-{b}", f"{a.upper()}_{b.upper()}", f"{a}.{b}", a])

    def harmless(self) -> str:
        """What looks like a secret and isn't."""
        h = "0123456789abcdef"
        d = f"20{self.draw('012', 1)}{self.draw(NUM, 1)}"
        uuid_ = "-".join(self.draw(h, n) for n in (8, 4, 4, 4, 12))
        path = "/".join(self.pick(THINGS) for _ in range(1 + self.upto(4)))
        host = f"{self.pick(['www', 'api', 'cdn', 'docs'])}.{self.word().lower()}.{self.pick(['com', 'org', 'io'])}"
        slug = "-".join(self.word().lower() for _ in range(2 + self.upto(5)))
        model = "".join(self.pick([self.word().title(), self.word().upper(), self.draw(NUM, 1, 4)]) for _ in range(2 + self.upto(4)))
        release = self.pick([self.word().title(), self.word().upper(), self.pick("aeiox") + self.word().title()]) + self.draw(NUM, 1, 4) + self.word().title() + self.pick(["", d, self.word().title(), d + self.word().title()])
        return self.pick([
            lambda: release, lambda: release, lambda: release, lambda: model, lambda: f"{release}-{self.draw(NUM, 1, 3)}",
            lambda: uuid_, lambda: uuid_.upper(), lambda: f"https://{host}/{path}/{self.pick([slug, self.draw(NUM, 2, 10), self.draw(LOW + UP + NUM, 4, 11), uuid_, model])}", lambda: f"https://{host}/{slug}.html?id={self.draw(NUM, 3, 9)}",
            lambda: f"{self.word().lower()}.{self.word().lower()}{self.draw(NUM, 0, 2)}@{host}", lambda: f"/usr/{path}/{self.name()}.py", lambda: f"{path}/{self.name()}_{self.draw(NUM, 1, 4)}.txt", lambda: f"{d}-{self.pick(['01', '09', '12'])}-{self.draw('012', 1)}{self.draw(NUM, 1)}T{self.draw('01', 1)}{self.draw(NUM, 1)}:30:15Z",
            lambda: f"{d}_{self.pick(['01', '11'])}_{self.draw('012', 1)}7_{self.name()}", lambda: model, lambda: model + d, lambda: f"{self.name()}{self.draw(NUM, 1, 3)}", lambda: f"v{self.draw(NUM, 1, 2)}.{self.draw(NUM, 1, 2)}.{self.draw(NUM, 1, 2)}-rc{self.draw(NUM, 1)}", lambda: self.draw(NUM, 1, 18),
            lambda: f"{self.draw(UP, 2, 4)}-{self.draw(NUM, 3, 8)}-{self.draw(UP, 1, 2)}", lambda: f"{self.draw(UP, 2)}{self.draw(NUM, 18, 20)}", lambda: f"+{self.draw(NUM, 1, 3)}-{self.draw(NUM, 3)}-{self.draw(NUM, 4)}", lambda: ".".join(self.draw(NUM, 1, 3) for _ in range(4)),
            lambda: f"{self.word()}.{self.draw(NUM, 2)}", lambda: f"#{self.draw(h, 6)}", lambda: self.draw(h, 7, 10), lambda: f"{self.name()}_{self.name()}_{self.draw(NUM, 1, 2)}", lambda: f"{self.word().lower()}{self.word().title()}", lambda: f"arn/{path}/{self.name()}-{self.draw(h, 4, 8)}", lambda: f"{self.word()}-{self.word()}", lambda: f"sha{self.draw(h, 5, 10)}",
            lambda: f"{self.word().title()}{d}{self.word().title()}", lambda: f"ISBN-{self.draw(NUM, 3)}-{self.draw(NUM, 10)}", lambda: f"{self.draw(NUM, 1, 2)}px", lambda: f"{self.draw(NUM, 4)}x{self.draw(NUM, 4)}", lambda: f"SS{self.word().lower()}", lambda: f"{self.name()}({self.name()})", lambda: f"{slug}-{self.draw(NUM, 1, 4)}",
        ])()

    def issued(self) -> str:
        """A secret that is known by its own form."""
        mixed = LOW + UP + NUM
        return self.pick([
            lambda: self.pick(LEADS) + self.draw(mixed, 20, 40), lambda: f"xoxb-{self.draw(NUM, 10, 12)}-{self.draw(NUM, 10, 12)}-{self.draw(mixed, 24)}", lambda: f"eyJ{self.draw(mixed, 17, 40)}.eyJ{self.draw(mixed, 30, 60)}.{self.draw(mixed + '-_', 43)}",
            lambda: f"AIza{self.draw(mixed + '_-', 35)}", lambda: self.draw(mixed + "+/", 40), lambda: self.draw(mixed + "+/", 30, 60) + "=", lambda: self.draw(mixed, 24, 48), lambda: self.draw("ABCDEF" + NUM, 32, 40), lambda: self.draw(UP + "234567", 24, 32),
        ])()

    def chosen(self) -> str:
        """One that only what stands next to it tells."""
        mixed = LOW + UP + NUM
        return self.pick([lambda: self.draw(mixed, 8, 20), lambda: self.word().title() + self.draw(NUM, 2, 5) + self.word().title(), lambda: self.word().lower() + self.draw(NUM, 2, 4) + self.draw(mixed, 3, 8), lambda: self.draw(LOW + NUM, 10, 24), self.issued])()

    def line(self, kind: str, secret: bool) -> list[tuple[str, bool]]:
        """Parts of a line, each with whether it is a secret."""
        words = lambda n: " ".join(self.word() for _ in range(1 + self.upto(n)))
        if not secret:
            thing = self.pick([self.harmless, self.harmless, self.word, self.name])()
            near = self.pick(sorted(CUES))
            by_kind = {
                "prose": [f"{words(9)} {thing} {words(6)}.", f"{words(12)}.", f"{words(4)}, {thing}; {words(3)}: {self.harmless()}", f"The {near} {words(3)} {thing}.", f"{words(5)} {self.word().lower()}.{self.draw(NUM, 2)}@mail{self.draw(NUM, 1)}.{self.word().lower()}.com {words(4)}", f"See {self.harmless()} for the {near}.", f"{words(3)} ({self.harmless()})", f"{self.pick(OPENERS)} {thing} {self.pick(CLOSERS)} {words(3)}"],
                "settings": [f"{self.name()}: {thing}", f"{self.name()} = {thing}", f'{self.name()}="{thing}"', f"{near}_{self.pick(['path', 'file', 'name', 'id', 'url', 'length'])} = {self.pick([self.name(), self.harmless()])}", f"# {words(6)}", f"{near}: {self.pick(['true', 'none', 'required', '${' + self.name() + '}', '<' + self.word() + '>'])}"],
                "code": [f"{self.name()} = {self.name()}({self.name()}, {thing});", f'if ({self.name()} == "{thing}") {{', f"import {self.name()}", f"def {self.name()}({near}, {self.name()}): # {thing}", f'  return "{thing}";', f'{{"{self.name()}": "{thing}"}}', f"}} // {words(4)}", f"{near} = {self.name()}.get({self.name()});"],
                "logs": [f"2024-05-0{self.draw('123456789', 1)}T10:{self.draw('12345', 1)}0:00Z INFO {self.name()} {thing} {words(3)}", f"[{self.name()}] {thing} took {self.draw(NUM, 1, 4)}ms", f"GET /{self.name()}/{thing} 200", f"request {self.harmless()} {words(3)}"],
            }
            return [(self.pick(by_kind[kind]), False)]
        key = self.pick(NAMED_SECRETS)
        issued, chosen = self.issued(), self.chosen()
        by_kind = {
            "prose": [[(f"{words(5)} ", False), (issued, True), (f" {words(4)}.", False)], [(f"The {self.pick(['password is', 'key is', 'passphrase is', 'login is', 'pwd is'])} ", False), (chosen, True), (f" {words(3)}", False)], [(f"{words(3)}: ", False), (issued, True)], [(f"{self.pick(OPENERS)} ", False), (issued, True), (f" {self.pick(CLOSERS)} {words(3)}", False)]],
            "settings": [[(f"{key}{self.pick([' = ', '=', ': '])}{self.pick(['', chr(34)])}", False), (chosen, True)], [(f"{self.name()}_url: {self.pick(['postgres', 'https', 'redis', 'amqp'])}://{self.word().lower()}:", False), (chosen, True), (f"@{self.word().lower()}.internal:5432/{self.name()}", False)], [(f"{self.name()} = ", False), (issued, True)], [(f"-----BEGIN {self.pick(['RSA ', '', 'EC '])}PRIVATE KEY-----\n", False), (self.draw(LOW + UP + NUM + "+/", 64), True), ("\n", None), (self.draw(LOW + UP + NUM + "+/", 64), True), ("\n-----END", False)]],
            "code": [[(f'{key} = "', False), (chosen, True), ('";', False)], [(f'{self.name()}.{self.pick(["auth", "login", "connect", "setKey"])}("', False), (issued, True), ('");', False)], [(f'{{"{key}": "', False), (chosen, True), ('"}', False)], [("headers = {'Authorization': 'Bearer ", False), (issued, True), ("'};", False)]],
            "logs": [[(f"INFO {self.name()} Authorization: {self.pick(['Bearer', 'Basic'])} ", False), (issued, True)], [(f"GET /{self.name()}?{self.pick(['key', 'sig', 'auth', 'access_key'])}=", False), (issued, True), (" 200", False)], [(f"{words(2)} {key}=", False), (chosen, True)], [(f"[{self.name()}] credentials ", False), (issued, True), (f" {words(2)}", False)]],
        }
        return self.pick(by_kind[kind])

    def file(self) -> Labelled:
        kind, text, spans = self.pick(["prose", "settings", "code", "logs"]), "", []
        for _ in range(1 + self.upto(4)):
            for part, secret in self.line(kind if self.upto(8) else "prose", self.upto(4) == 0):
                if secret:
                    spans.append((len(text), len(text) + len(part)))
                text += part
            text += "\n"
        return text, spans


def written_files(count: int = 1800, seed: int = 7) -> list[Labelled]:
    writer = Writer(seed)
    return [writer.file() for _ in range(count)]


def sequence(file: Labelled) -> tuple[list[str], tuple[str, ...], list[int]]:
    """(words, features of the text, tags) of a file whose secrets are known. Neighbouring tokens of touching spans, but for
    white space, are one secret."""
    text, spans = file
    tokens = list(TOKEN.finditer(text))
    tags = [0] * len(tokens)
    for a, b in spans:
        inside = [k for k, m in enumerate(tokens) if m.start() < b and a < m.end()]
        for k in inside:
            tags[k] = 2 if k and tags[k - 1] and not text[tokens[k - 1].end() : tokens[k].start()].strip() else 1
    return [m.group() for m in tokens], features_of_text(text), tags


def fit(data: list[tuple[list[str], tuple[str, ...], list[int]]], rounds: int = 100, rate: float = 0.3, ridge: float = 0.3) -> Model:
    """Most likely weights, less a penalty on their squares, by gradient steps, one adaptive rate a weight; gradients by the
    forward-backward recursion over all sequences at once, the longest first, so that a step takes those that reach it."""
    data = sorted((d for d in data if d[0]), key=lambda d: -len(d[0]))
    index: dict[str, int] = {}
    size, longest = len(data), len(data[0][0])
    reach = [sum(len(d[0]) > k for d in data) for k in range(longest + 1)]
    rows, cells, inside, gold = [], [], np.zeros((size, longest), bool), np.zeros((size, longest), int)
    for s, (words, text, tags) in enumerate(data):
        for k, fs in enumerate(names_of(words, text)):
            rows += [index.setdefault(f, len(index)) for f in fs]
            cells += [s * longest + k] * len(fs)
        inside[s, : len(tags)], gold[s, : len(tags)] = True, tags
    rows, cells = np.array(rows), np.array(cells)
    used, firsts = np.unique(cells, return_index=True)  # cells ascend
    w, t = np.zeros((len(index), 3)), np.zeros((3, 3))
    sw, st = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    truth = np.eye(3)[gold] * inside[..., None]
    moves = np.einsum("skp,skx->px", truth[:, :-1], truth[:, 1:])
    last = np.array([len(d[0]) - 1 for d in data])
    sums = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    for _ in range(rounds):
        e = np.zeros((size * longest, 3))
        e[used] = np.add.reduceat(w[rows], firsts)
        e = e.reshape(size, longest, 3)
        a, b = e.copy(), np.zeros_like(e)
        for k in range(1, longest):
            n = reach[k]
            a[:n, k] = sums(a[:n, k - 1, :, None] + t, 1) + e[:n, k]
        for k in range(longest - 2, -1, -1):
            n = reach[k + 1]
            b[:n, k] = sums(t + (e[:n, k + 1] + b[:n, k + 1])[:, None, :], 2)
        z = sums(a[np.arange(size), last], 1)
        p = np.exp(a + b - z[:, None, None]) * inside[..., None]
        missed, gt = (truth - p).reshape(-1, 3)[cells], moves - ridge * t
        gw = np.stack([np.bincount(rows, missed[:, x], len(index)) for x in range(3)], 1) - ridge * w
        for k in range(1, longest):
            n = reach[k]
            gt -= np.exp(a[:n, k - 1, :, None] + t + (e[:n, k] + b[:n, k])[:, None, :] - z[:n, None, None]).sum(0)
        sw += gw**2
        st += gt**2
        w += rate * gw / np.sqrt(sw)
        t += rate * gt / np.sqrt(st)
    return Model({f: w[k].tolist() for f, k in index.items()}, t.tolist())


_FITTED: dict[str, Model] = {}


def default_model() -> Model:
    if "default" not in _FITTED:
        _FITTED["default"] = fit([sequence(f) for f in written_files()])
    return _FITTED["default"]


class Scanner:
    """Spans of whole texts. Whether a white-space token can hold anything but outside tags is remembered by token."""

    def __init__(self, model: Model, remembered: int = 100_000):
        self.model, self.remembered = model, remembered
        self.plain: dict[str, bool] = {}
        self.words_safe = all(map(model.is_outside, ("word", "token", ",")))

    def _is_plain(self, chunk: str) -> bool:
        core = chunk.rstrip(".,;!?")
        if self.words_safe and core.isalpha() and (core.islower() or core.istitle() or core.isupper()):
            return True  # words and marks alone; cheaper to see than to remember
        if len(self.plain) >= self.remembered:
            self.plain.clear()
        out = self.plain[chunk] = all(self.model.is_outside(w) for w in TOKEN.findall(chunk))
        return out

    def crf_spans(self, text: str) -> list[Span]:
        known = self.plain.get
        if all(self._is_plain(c) if (p := known(c)) is None else p for c in set(text.split())):
            return []
        tokens = list(TOKEN.finditer(text))
        words = [m.group() for m in tokens]
        sure = {w: self.model.is_outside(w) for w in set(words)}
        outside = [sure[w] for w in words]
        about = features_of_text(text)
        out: list[Span] = []
        k, n = 0, len(words)
        while k < n:
            if outside[k]:
                k += 1
                continue
            end = k
            while end < n and not outside[end]:
                end += 1
            first, last = max(0, k - 1), min(n, end + 1)  # with the outside tokens at either side
            near = max(0, first - 2)
            scores = self.model.scores(words[near : last + 2], about)[first - near : last - near]
            tags = self.model.viterbi(scores)
            begun = None
            for j, tag in enumerate([*tags, 0]):
                if begun is not None and tag != 2:
                    out.append(("crf", tokens[first + begun].start(), tokens[first + j - 1].end()))
                    begun = None
                if tag == 1 or tag == 2 and begun is None:
                    begun = j
            k = end
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans; both by start, then kind as listed."""
        order = lambda s: (s[1], KINDS.index(s[0]), s[2])
        base = sorted(base_spans(text), key=order)
        taken = [(a, b) for _, a, b in base]
        more = [s for s in self.crf_spans(text) if not any(a <= s[1] and s[2] <= b for a, b in taken)]
        return base, sorted([*base, *more], key=order)


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: Sequence[Span], mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


FOUND = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_crf", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def secret_scan(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""
    shared = spark.sparkContext.broadcast(model or default_model())  # a few hundred weights
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept("scanner", key, lambda: Scanner(shared.value))
        for ids, texts in rows_of(batches):
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                base, spans = scanner.spans(text)
                counts = [sum(s[0] == k for s in spans) for k in KINDS]
                out.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string")


def redact_documents(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows the text. All rows and columns stay."""
    shared = spark.sparkContext.broadcast(model or default_model())
    key = uuid.uuid4().hex

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = kept("scanner", key, lambda: Scanner(shared.value))
        for texts in batches:
            yield pa.array((None if t is None else redacted(t, scanner.spans(t)[1]) for part in values_of(texts) for t in part), pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out
