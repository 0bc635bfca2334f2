"""Secret scans: base patterns and a linear-chain conditional random field.

Every whole text is cut into white-space tokens. A token has a shape class and, if it is one of the field's words, a word
class. The field scores the tags outside, begin and inside from the token's shape, its neighbours' shapes, the words one
to three before and the word after it, and a feature of the whole text; Viterbi finds the best tags. Patterns' spans always
stay; the field adds spans of tokens that no pattern's span touches.

The field learns from two sources. One are windows around tokens that aren't plain words, of at most `fit_docs` documents
(those with the smallest hashes of their ids), tagged by the base patterns; a window counts at most `MOST_TIMES` times. As the patterns
miss secrets, a window where a token like a secret follows an announcing word by at most `REACH` tokens, outside of the
patterns' spans, counts for nothing. The others are made-up sentences: random values after and before announcing words, in forms that the patterns
miss, and the same values in harmless places. Their other words come from the corpus. The field's words are the announcing
ones, those of the made-up sentences, and the `vocabulary` most frequent ones of the sample.

Where the outside score leads by more than any change of transitions can return, the best path must pass outside
there; such tokens cut the chain, and Viterbi runs on the stretches between. This is exact.

Null and empty texts have no spans. Repeated rows give repeated results, ties keep the lower tag (outside first), an
empty table gives an empty result, and extra columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import map_arrow, texts

#: Fixed patterns: kind, expression, least length, and the group that must have it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

#: Documents that the field is fitted on, windows of tokens that are kept of them, tokens to either side, and how often a window counts at most.
FIT_DOCS, FIT_WINDOWS, REACH, MOST_TIMES = 6_000, 6_000, 4, 50
#: Frequent words of the sample that the field knows; made-up sentences, and how often each counts.
VOCABULARY, SENTENCES, TIMES = 500, 1_500, 3

#: Words that announce a secret.
KEYWORDS = frozenset("password passwd pwd passphrase secret token apikey api_key api-key key credential credentials auth bearer authorization access_key secret_key private_key".split())
SHAPES = ("word", "Title", "CAPS", "number", "marks", "keyword", "keyword=", "separator", "keyword=value", "long hex", "long mixed", "CAPS+digits", "address", "short mixed", "symbols", "name=value", "medium mixed", "odd mixed", "edge")
SHAPE = {s: i for i, s in enumerate(SHAPES)}
EDGE = SHAPE["edge"]
PUNCTUATION = ".,;:!?()[]{}<>\"'`«»…"
_ALNUM = re.compile(r"[A-Za-z0-9+/_.=-]+", re.A)
_NAME_VALUE = re.compile(r"[\"']?([A-Za-z][A-Za-z0-9_-]*)[\"']?[:=][\"']?([A-Za-z0-9+/_.=-]*)", re.A)
_HEX_TOKEN = re.compile(r"[0-9a-fA-F]{16,}")


def shape(token: str) -> int:
    """The shape class of a token."""
    core = token.strip(PUNCTUATION)
    if not core:
        return SHAPE["separator"] if token in (":", "=", ":=") else SHAPE["marks"]
    if core.isalpha():
        if core.lower() in KEYWORDS:
            return SHAPE["keyword="] if token[-1] in ":=" else SHAPE["keyword"]
        return SHAPE["word"] if core.islower() else SHAPE["CAPS"] if core.isupper() and len(core) > 1 else SHAPE["Title"]
    if core in ("=", ":="):
        return SHAPE["separator"]
    if core.isdigit():
        return SHAPE["number"]
    if "@" in core or "://" in core:
        return SHAPE["address"]
    bare = core.rstrip("=:")
    if bare.lower() in KEYWORDS:
        return SHAPE["keyword="] if bare != core or token[-1] in ":=" else SHAPE["keyword"]
    if m := _NAME_VALUE.match(token):
        if m[1].lower() in KEYWORDS and len(m[2]) >= 6:
            return SHAPE["keyword=value"]
        return SHAPE["name=value"]
    if _ALNUM.fullmatch(core):
        digits = sum(map(str.isdigit, core))
        letters = sum(map(str.isalpha, core))
        if len(core) >= 16 and digits and _HEX_TOKEN.fullmatch(core):
            return SHAPE["long hex"]
        if len(core) >= 16 and digits and letters and core.isupper() and core.isalnum():
            return SHAPE["CAPS+digits"]
        if len(core) >= 16 and digits >= 2 and letters >= 4:
            return SHAPE["long mixed"]
        if digits and letters and len(core) >= 8:
            return SHAPE["medium mixed"]
        if digits:
            return SHAPE["short mixed"] if letters else SHAPE["number"]
    if len(core) >= 8 and core.isascii() and any(map(str.isdigit, core)) and any(map(str.isalpha, core)):
        return SHAPE["odd mixed"]
    return SHAPE["symbols"]


#: Shapes of tokens that may be secrets, and of those that announce one.
LIKE_SECRETS = frozenset(SHAPE[x] for x in ("long hex", "long mixed", "CAPS+digits", "medium mixed", "odd mixed", "short mixed"))
ANNOUNCING = frozenset(SHAPE[x] for x in ("keyword", "keyword="))
#: Made-up forms with a secret at {}, and forms with such a value that is none, or an announcing word without one.
SECRET_FORMS = (
    "bearer {}", "Authorization: Bearer {}", "password is {}", "my password is {} and", "passphrase {}", "the passphrase was {} until", "api_key {}", "use key {} for", "auth {}", "auth token {}",
    "secret - {}", "a secret {} was found", "with credentials {}", "credentials bob {}", "the token {} works", "private_key {} follows", "secret_key {}", "access_key {}", "passwd for root {}", "pwd {}",
    "the new password of the server is {}", "log in with {} as password", "password ( {} )", "token -> {}", "secret is now {}", "api-key is {}", "sign with key {}", "pass {}", "login root {}", "password \" {} \"",
)
HARMLESS_FORMS = (
    "order {} was sent", "see page {} of it", "the item {} is out", "model {} from the list", "version {}", "room {}", "commit {}", "file {} is here", "id {}", "part {} fits", "figure {}", "call {} now", "ref {}", "ticket {} is closed", "{}",
    "a token of thanks", "the secret of the old house is known", "the password again and again", "the key word in this text", "password must have 8 letters", "no credentials are needed", "the key is in the drawer", "keep the secret", "an auth page", "the token is lost", "bearer of news",
)
FILLERS = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()


def made_up_value(rng: random.Random) -> str:
    """A random value in one of the looks that secrets have."""
    letters, digits = string.ascii_letters, string.digits
    kind = rng.randrange(7)
    if kind == 0:
        return "".join(rng.choices(letters + digits + "+/_-", k=rng.randrange(16, 41))) + rng.choice("0123456789") * 2
    if kind == 1:
        return "".join(rng.choices("0123456789abcdef", k=rng.randrange(16, 24)))
    if kind == 2:
        return "".join(rng.choices(string.ascii_uppercase + digits, k=rng.randrange(16, 33)))
    if kind == 3:
        return "eyJ" + ".".join("".join(rng.choices(letters + digits, k=rng.randrange(8, 20))) for _ in range(3))
    if kind == 4:
        return "-".join("".join(rng.choices(string.ascii_uppercase + digits, k=5)) for _ in range(rng.randrange(3, 6)))
    value = rng.choices(letters, k=rng.randrange(5, 9)) + rng.choices(digits, k=rng.randrange(3, 6)) + (rng.choices("!#$%&*?", k=2) if kind == 5 else [])
    rng.shuffle(value)
    return rng.choice(letters) + "".join(value) + rng.choice(letters)


def made_up(fillers: Sequence[str] = FILLERS, count: int = SENTENCES, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Sentences as tokens and tags; as many harmless ones as ones with a secret."""
    rng = random.Random(seed)
    out = []
    # Some words are ones that nobody knows, as words beside secrets mostly are.
    unknown = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(2, 10)))
    other = lambda w: w if w == "{}" or not w.isalpha() or w.lower() in KEYWORDS or rng.random() < 0.6 else unknown()
    for i in range(count):
        form = list(map(other, rng.choice(HARMLESS_FORMS if i % 2 else SECRET_FORMS).split()))
        around = [list(map(other, rng.choices(fillers, k=rng.randrange(0, 5)))) for _ in range(2)]
        value = made_up_value(rng) + rng.choice(["", "", ".", ","])
        out.append(([*around[0], *(value if w == "{}" else w for w in form), *around[1]], [*[0] * len(around[0]), *(int(w == "{}" and i % 2 == 0) for w in form), *[0] * len(around[1])]))
    return out


def form_words() -> list[str]:
    """The announcing words and the words of the made-up forms."""
    return sorted({w.strip(PUNCTUATION).lower() for form in (*SECRET_FORMS, *HARMLESS_FORMS) for w in form.split() if w != "{}"} | KEYWORDS | set(FILLERS))


class Codes(dict):
    """Shape and word class of tokens met before, as shape + 32 x word; bounded."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[token] = code = shape(token) + (self.words.get(token.strip(PUNCTUATION).lower(), 0) << 5)
        return code


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order of start, then kind."""
    spans = []
    low = text.encode("utf-8", "replace").lower()
    if (b":" in low or b"=" in low) and (b"passw" in low or b"token" in low or b"secret" in low or b"api" in low):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Kinds of whole texts.
FILES = 8


def file_feature(shapes: np.ndarray) -> int:
    """Which kind of text: 1 for tokens of secrets' shapes, 2 for many names and values or addresses, 4 for announcing words, added up."""
    n = np.bincount(shapes, minlength=len(SHAPES))
    risky = int(n[[SHAPE[s] for s in ("keyword=value", "long hex", "long mixed", "CAPS+digits")]].sum())
    settings = int(n[SHAPE["name=value"]] + n[SHAPE["address"]])
    return (risky > 0) + 2 * (settings > 3 and settings * 20 > len(shapes)) + 4 * (int(n[list(ANNOUNCING)].sum()) > 0)


#: Where the words beside a token are that count.
BESIDE = (-3, -2, -1, 1)


class Field:
    """A linear-chain field with tags 0 outside, 1 begin, 2 inside."""

    def __init__(self, unary: np.ndarray, near: np.ndarray, files: np.ndarray, moves: np.ndarray, words: dict[str, int] | None = None):
        #: unary[o]: shapes by tags, for the token before, the token and the one after; near[o]: words by tags, for BESIDE[o] tokens on.
        self.unary, self.near, self.files, self.moves, self.words = unary, near, files, moves, words or {}
        #: The most that tags' transitions can win back by leaving the outside tag at one token.
        self.slack = float(max((moves[:, s] - moves[:, 0]).max() for s in (1, 2)) + max((moves[s, :] - moves[0, :]).max() for s in (1, 2)))

    def scores(self, codes: np.ndarray, file: int) -> np.ndarray:
        shapes, words = codes & 31, codes >> 5
        before = np.concatenate(([EDGE], shapes[:-1]))
        after = np.concatenate((shapes[1:], [EDGE]))
        e = self.unary[0][before] + self.unary[1][shapes] + self.unary[2][after] + self.files[file]
        for o, near in zip(BESIDE, self.near, strict=True):
            beside = np.zeros(len(words), words.dtype)
            if o < 0:
                beside[-o:] = words[:o]
            else:
                beside[:-o] = words[o:]
            e += near[beside]
        return e

    def tags(self, codes: np.ndarray, file: int) -> dict[int, int]:
        """Tags other than outside, by position."""
        e = self.scores(codes, file)
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= self.slack + 1e-9)
        found: dict[int, int] = {}
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            best = (self.moves[0] if a else np.where([True, True, False], 0.0, -1e9)) + e[a]
            back = []
            for t in range(a + 1, b):
                total = best[:, None] + self.moves
                back.append(total.argmax(axis=0))
                best = total.max(axis=0) + e[t]
            tag = int((best + self.moves[:, 0]).argmax()) if b < len(codes) else int(best.argmax())
            for t in range(b - 1, a - 1, -1):
                if tag:
                    found[t] = tag
                tag = int(back[t - a - 1][tag]) if t > a else 0
        return found


#: A window: codes (with three neighbours before and one after), tags, file feature, count.
Window = tuple[bytes, bytes, int, int]


class Likelihood:
    """The logarithmic likelihood of windows with a ridge, and its gradient, as functions of all weights in one array."""

    def __init__(self, windows: Sequence[Window], words: int, ridge: float = 2.0):
        self.ridge, self.length = ridge, max(len(t) for _, t, _, _ in windows)
        x = np.full((len(windows), self.length + 4), EDGE)
        self.y = np.zeros((len(windows), self.length), int)
        for i, (c, t, _, _) in enumerate(windows):
            x[i, : len(t) + 4] = np.frombuffer(c, np.uint16)
            self.y[i, : len(t)] = list(t)
        lens = np.array([len(t) for _, t, _, _ in windows])
        self.file = np.array([w[2] for w in windows])
        self.live = np.arange(self.length) < lens[:, None]
        self.weight = np.array([w[3] for w in windows], float)[:, None] * self.live
        self.shapes, self.words = [(x & 31)[:, o : o + self.length] for o in (2, 3, 4)], [(x >> 5)[:, 3 + o : 3 + o + self.length] for o in BESIDE]
        self.sizes = [(3, len(SHAPES), 3), (len(BESIDE), words, 3), (FILES, 3), (3, 3)]

    def parts(self, v: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for size in self.sizes:
            n = int(np.prod(size))
            out.append(v[at : at + n].reshape(size))
            at += n
        return out

    def start(self) -> np.ndarray:
        return np.zeros(sum(int(np.prod(s)) for s in self.sizes))

    def __call__(self, v: np.ndarray) -> tuple[float, np.ndarray]:
        unary, near, files, moves = self.parts(v)
        g = np.zeros_like(v)
        gu, gn, gf, gm = self.parts(g)
        e = sum(t[x] for t, x in zip((*unary, *near), (*self.shapes, *self.words), strict=True)) + files[self.file][:, None, :]
        alpha, beta, length, live = np.zeros_like(e), np.zeros_like(e), self.length, self.live
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + e[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        d = (np.eye(3)[self.y] - np.exp(alpha + beta - z[:, None, None])) * self.weight[..., None]
        for of, x in zip((*gu, *gn), (*self.shapes, *self.words), strict=True):
            for tag in range(3):
                of[:, tag] += np.bincount(x.ravel(), d[..., tag].ravel(), len(of))
        np.add.at(gf, self.file, d.sum(axis=1))
        w = self.weight[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * w[..., None, None]
        gm -= pair.sum(axis=(0, 1))
        np.add.at(gm, (self.y[:, :-1], self.y[:, 1:]), w)
        of_y = np.take_along_axis(e, self.y[..., None], axis=2)[..., 0]
        value = (of_y * self.weight).sum() + (moves[self.y[:, :-1], self.y[:, 1:]] * w).sum() - (z * self.weight[:, 0]).sum()
        return float(value - self.ridge / 2 * (v @ v)), g - self.ridge * v


def fit_field(windows: Sequence[Window], words: dict[str, int], steps: int = 120, ridge: float = 2.0) -> Field:
    """Maximum likelihood with a ridge, by resilient gradient steps."""
    likelihood = Likelihood(windows, len(words) + 1, ridge)
    theta = likelihood.start()
    size, last = np.full_like(theta, 0.1), np.zeros_like(theta)
    for _ in range(steps):
        g = likelihood(theta)[1]
        same = np.sign(g) * np.sign(last)
        size = np.clip(np.where(same > 0, size * 1.2, np.where(same < 0, size * 0.5, size)), 1e-5, 1.0)
        g = np.where(same < 0, 0, g)
        theta = theta + np.sign(g) * size
        last = g
    return Field(*(a.copy() for a in likelihood.parts(theta)), words)


def padded(codes: np.ndarray) -> np.ndarray:
    return np.concatenate(([EDGE] * 3, codes, [EDGE])).astype(np.uint16)


def examples(words: dict[str, int], fillers: Sequence[str] = FILLERS, times: int = TIMES) -> list[Window]:
    """The made-up sentences as windows."""
    codes, out = Codes(words), []
    for tokens, tags in made_up(fillers):
        c = np.fromiter((codes[w] for w in tokens), np.uint16, len(tokens))
        out.append((padded(c).tobytes(), bytes(tags), file_feature(c & 31), times))
    return out


def _windows(words: dict[str, int]):
    """Windows around tokens that aren't plain words, and the texts' first tokens as examples of prose."""
    plain = [SHAPE[s] for s in ("word", "Title", "CAPS", "marks")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, found = Codes(words), Counter()

        def out() -> pa.RecordBatch:
            keys, n = list(found), list(found.values())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array(n, pa.int64())], ["codes", "tags", "file", "n"])

        for b in batches:
            for text in texts(b):
                tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
                if not tokens:
                    continue
                codes = np.fromiter((seen[text[i:j]] for i, j in tokens), np.uint16, len(tokens))
                shapes = codes & 31
                starts, tags = np.array([i for i, _ in tokens]), np.zeros(len(tokens), np.uint8)
                for start, _, end in base_spans(text):
                    first = int(np.searchsorted(starts, start, "right")) - 1
                    last = int(np.searchsorted(starts, end, "left"))
                    tags[first:last] = np.maximum(tags[first:last], 2)
                    tags[first] = 1
                words_before = np.cumsum(np.append(np.zeros(REACH + 1, int), np.isin(shapes, list(ANNOUNCING))))
                announced = words_before[REACH:-1] > words_before[: -REACH - 1]
                doubtful = np.flatnonzero((tags == 0) & np.isin(shapes, list(LIKE_SECRETS)) & announced)
                file, wide = file_feature(shapes), padded(codes)
                for t in [0, *np.flatnonzero(~np.isin(shapes, plain)).tolist()]:
                    a, e = max(0, t - REACH), min(len(tokens), t + REACH + 1)
                    if np.searchsorted(doubtful, a) < np.searchsorted(doubtful, e):
                        continue
                    found[wide[a : e + 4].tobytes(), tags[a:e].tobytes(), file] += 1
                    if len(found) > 50_000:
                        yield out()
            yield out()

    return run


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = Counter(w.strip(PUNCTUATION).lower() for t in texts(b) for w in t.split())
        n = {w: c for w, c in n.items() if w.isalpha()}
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS, vocabulary: int = VOCABULARY) -> Field:
    """The field, learnt from the documents whose ids have the smallest hashes; the numbers bound the sample, its windows and its words."""
    h = F.xxhash64("doc_id")
    limit = docs.select(h.alias("h")).orderBy("h").limit(fit_docs).agg(F.max("h")).first()[0]
    own = form_words()
    if limit is None:
        words = {w: i for i, w in enumerate(own, 1)}
        return fit_field(examples(words), words)
    sample = docs.where(h <= limit).select("text")
    counted = map_arrow(sample, _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word")
    frequent = [r.word for r in counted.limit(vocabulary).collect()]
    words = {w: i for i, w in enumerate(dict.fromkeys([*own, *frequent]), 1)}
    seen = map_arrow(sample, _windows(words), "codes binary, tags binary, file int, n long")
    rows = seen.groupBy("codes", "tags", "file").agg(F.sum("n").alias("n")).orderBy(F.hex("tags").contains("1").desc(), F.col("n").desc(), "codes", "tags", "file").limit(fit_windows).collect()
    return fit_field([*examples(words, frequent or FILLERS), *((bytes(r["codes"]), bytes(r.tags), r.file, min(r.n, MOST_TIMES)) for r in rows)], words)


class Scanner:
    """Spans of a text: the base patterns' and those that the field adds."""

    def __init__(self, field: Field):
        self.field, self.seen = field, Codes(field.words)

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = base_spans(text)
        words = text.split()
        if not words:
            return base, base
        codes = np.fromiter(map(self.seen.__getitem__, words), np.uint16, len(words))
        tags = self.field.tags(codes, file_feature(codes & 31))
        if not tags:
            return base, base
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        added: list[list[int]] = []
        for t in sorted(tags):
            if tags[t] == 2 and added and added[-1][2] == t - 1:
                added[-1][1:] = at[t][1], t
            else:
                added.append([*at[t], t])
        more = []
        for a, b, _ in added:
            while a < b and text[a] in PUNCTUATION:
                a += 1
            while b > a and text[b - 1] in PUNCTUATION:
                b -= 1
            if a < b and not any(x < b and a < y for x, _, y in base):
                more.append((a, 3, b))
        return base, sorted(base + more)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base kinds, digest of the base spans, all spans, and how many the field added."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        for b in batches:
            found = [scanner(t) for t in texts(b)]
            counts = [[sum(k == kind for _, k, _ in spans) for _, spans in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x, _ in found], pa.string()), pa.array([joined(x) for _, x in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span of `text` replaced by the mask and n_chars set anew; a null text stays null. Other columns pass through."""
    names = docs.columns
    has_n = "n_chars" in names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(field)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                end = 0
                if t and (spans := scanner(t)[1]):
                    parts = []
                    for a, _, z in spans:
                        if a >= end:
                            parts += [t[end:a], mask]
                        end = max(end, z)
                    t = "".join([*parts, t[end:]])
                out.append(t)
            b = b.set_column(names.index("text"), "text", pa.array(out, b.column("text").type))
            if has_n:
                i = names.index("n_chars")
                b = b.set_column(i, "n_chars", pa.array([None if t is None else len(t) for t in out], b.column(i).type))
            yield b

    return map_arrow(docs, run, docs.schema)
