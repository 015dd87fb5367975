"""Secret scanning: fixed patterns, and a character convolutional network over all further candidates.

A candidate is a run of 16 or more of ``[A-Za-z0-9+/_=-]`` with a letter and two digits. The network
reads it in overlapping windows, to its last character, each with the characters around it: an
embedding, one convolution, the maximum over the window's value and over its surroundings, a hidden
layer. A candidate's probability is the highest of its windows.

It is trained in numpy on labelled findings: what the patterns found in all documents (a bounded
number, by a hash of the window), and keys made up after the published formats of some providers,
between characters of the corpus. Against them stand other long runs of a bounded sample of documents,
and names, paths and numbers made up from their words. The threshold has to recall ``recall`` of
kinds that a network has *not* seen: the kinds are dealt in folds, each fold's are judged by a network
that learned from the others, Platt scaling of these scores calibrates, and the threshold is the
highest that recalls enough of them. The share of kept-out other runs above it is reported.

Defined cases: a null or empty text has no spans; with fewer than ten other runs to learn from nothing
is added to the patterns' spans, and ``fit`` warns of it; repeated rows are scanned alike; an empty
table gives no rows; a very long text or run is read to its end; columns other than doc_id and text
are not read. The model doesn't depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
import random
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import filled_text, keyed_text, over_chunks, per_chunk, remove, shared_dir, string_bytes

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# a run is taken whole, so its least length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_MAYBE_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]"

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True

#: Bytes of text at a time: finding runs takes about forty times as much memory.
_CHUNK = 2 << 20

SIDE, VALUE = 28, 44
#: From window to window of a longer value: what has up to VALUE - _STRIDE + 1 characters lies whole in one.
_STRIDE = 11
WIDTH = SIDE + VALUE + SIDE


def runs(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of candidate characters of at least ``least``: text, start, end in bytes; digits, letters in them."""
    raw, starts = string_bytes(texts)
    # a separator after each text keeps runs apart
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    inside = _RUN[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    # cut runs that reach over the border of two texts
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    across = np.unique(cuts[(inside[cuts - 1] & inside[cuts]) if len(cuts) else slice(0)])
    begin, end = np.sort(np.concatenate([begin, across])), np.sort(np.concatenate([end, across]))
    long = end - begin >= least
    begin, end = begin[long], end[long]
    digits, letters = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (_DIGIT, _ALPHA))
    d = doc[begin] if len(begin) else np.zeros(0, np.int64)
    return d, begin - starts[d], end - starts[d], digits[end] - digits[begin], letters[end] - letters[begin]


def base_spans(text: str, assign: bool, access: bool, hexes: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' findings; the flags say which can occur."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8] if assign else []
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if access else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)] if hexes else []
    return sorted(out)


def window(text: str, start: int, end: int) -> bytes:
    """Surroundings and value as ``WIDTH`` bytes: characters beyond ASCII are 1, missing ones 0."""
    code = lambda s: s.encode("ascii", "replace").replace(b"?", b"\x01") if not s.isascii() else s.encode()
    return code(text[max(0, start - SIDE) : start]).rjust(SIDE, b"\0") + code(text[start : min(end, start + VALUE)]).ljust(VALUE, b"\0") + code(text[end : end + SIDE]).ljust(SIDE, b"\0")


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Overlapping parts of at most ``VALUE`` characters; the last one ends with the value."""
    for at in range(start, max(start, end - VALUE), _STRIDE):
        yield at, at + VALUE
    yield max(start, end - VALUE), end


def _some(start: int, end: int, most: int = 4) -> list[tuple[int, int]]:
    """About ``most`` pieces to learn from, the first one and the last one among them."""
    all_ = list(pieces(start, end))
    return sorted({*all_[:: -(-len(all_) // most)], all_[-1]})


@dataclass
class SecretModel:
    """The network's parameters, its calibration (slope, intercept) and threshold; without parameters it adds nothing."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 2.0
    report: dict[str, float] = field(default_factory=dict)  # recall of kinds left out, by kind and in all; false positives

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, k = self.p, 5
        e = p["embed"][x]  # rows, WIDTH, 8
        cols = np.lib.stride_tricks.sliding_window_view(np.pad(e, ((0, 0), (2, 2), (0, 0))), k, axis=1)
        cols = cols.reshape(len(x), WIDTH, -1)
        h = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        value = h[:, SIDE : SIDE + VALUE]
        mean = value.mean(1)
        around = np.concatenate([h[:, :SIDE], h[:, SIDE + VALUE :]], 1)
        top, side = value.argmax(1), around.argmax(1)
        f = np.concatenate([value.max(1), mean, around.max(1)], 1)
        z = np.maximum(f @ p["dense"] + p["dense_b"], 0)
        return z @ p["out"] + p["out_b"][0], (x, cols, h, top, side, f, z)

    def probability(self, windows: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for i in range(0, len(windows), 512):
            x = np.frombuffer(b"".join(windows[i : i + 512]), np.uint8).reshape(-1, WIDTH) & 127
            logit, _ = self.forward(x)
            out.append(1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -50, 50))))
        return np.concatenate(out)

    def gradients(self, d: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, cols, h, top, side, f, z) = self.p, kept
        g = {"out": z.T @ d, "out_b": np.array([d.sum()])}
        dz = np.outer(d, p["out"]) * (z > 0)
        g["dense"], g["dense_b"] = f.T @ dz, dz.sum(0)
        df = dz @ p["dense"].T
        n, c = len(x), h.shape[2]
        dh, rows, ch = np.zeros_like(h), np.arange(n)[:, None], np.arange(c)[None]
        np.add.at(dh, (rows, SIDE + top, ch), df[:, :c])
        dh[:, SIDE : SIDE + VALUE] += df[:, None, c : 2 * c] / VALUE
        np.add.at(dh, (rows, np.where(side < SIDE, side, side + VALUE), ch), df[:, 2 * c :])
        dh *= h > 0
        g["conv"], g["conv_b"] = cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, c), dh.sum((0, 1))
        dcols = (dh @ p["conv"].T).reshape(n, WIDTH, -1, 5)
        de = np.zeros((n, WIDTH + 4, dcols.shape[2]))
        for k in range(5):
            de[:, k : k + WIDTH] += dcols[..., k]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x, de[:, 2:-2])
        return g


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _UPPER + _LOWER + _DIGITS
#: Published formats of keys, as parts that are literal or (alphabet, length).
FORMATS: dict[str, list[str | tuple[str, int]]] = {
    "github": ["ghp_", (_MIXED, 36)],
    "github_fine": ["github_pat_", (_MIXED, 22), "_", (_MIXED, 59)],
    "gitlab": ["glpat-", (_MIXED + "-_", 20)],
    "slack_bot": ["xoxb-", (_DIGITS, 11), "-", (_DIGITS, 12), "-", (_MIXED, 24)],
    "stripe": ["sk_live_", (_MIXED, 24)],
    "google": ["AIza", (_MIXED + "-_", 35)],
    "aws_secret": [(_MIXED + "+/", 40)],
    "jwt_part": ["eyJ", (_MIXED + "-_", 60)],
    "npm": ["npm_", (_MIXED, 36)],
    "twilio": ["SK", (_DIGITS + "abcdef", 32)],
    "hex_28": [(_DIGITS + "abcdef", 28)],
    "base64_32": [(_MIXED + "+/", 43), "="],
    "lower_24": [(_LOWER + _DIGITS, 24)],
    "upper_20": [(_UPPER + _DIGITS, 20)],
    "mixed_18": [(_MIXED, 18)],
    "mixed_32": [(_MIXED, 32)],
}
_BEFORE = [" ", "=", ": ", '"', "'", "(", "\n", ",", "Bearer ", "key ", "<", ":"]
_AFTER = [" ", '"', "'", ")", "\n", ",", ".", ";", ">", "&"]


def made_up_keys(others: list[bytes], each: int, seed: int) -> dict[str, list[bytes]]:
    """Windows of keys after ``FORMATS`` between surroundings of other runs."""
    rng = random.Random(seed)
    around = [(w[:SIDE].lstrip(b"\0").decode("latin-1"), w[SIDE + VALUE :].rstrip(b"\0").decode("latin-1")) for w in others]
    out: dict[str, list[bytes]] = {}
    for kind, parts in FORMATS.items():
        out[kind] = []
        while len(out[kind]) < each:
            value = "".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=p[1])) for p in parts)
            left, right = rng.choice(around)[0] + rng.choice(_BEFORE), rng.choice(_AFTER) + rng.choice(around)[1]
            text = left + value + right
            out[kind] += [window(text, *x) for x in _some(len(left), len(left) + len(value), 2)]
    return out


def made_up_names(others: list[bytes], n: int, seed: int) -> list[bytes]:
    """Windows of paths, identifiers, numbers and dates from words of other runs."""
    rng = random.Random(seed)
    values = [re.sub(r"[^A-Za-z]", "", w[SIDE : SIDE + VALUE].decode("latin-1")) for w in others]
    named = sorted({v for v in values if 2 < len(v) < 30}) or ["value", "name", "file"]
    around = [(w[:SIDE].lstrip(b"\0").decode("latin-1"), w[SIDE + VALUE :].rstrip(b"\0").decode("latin-1")) for w in others]

    def word() -> str:
        w = rng.choice(named)
        w = w[: rng.randint(3, 12)]
        return rng.choice([w, w, w.lower(), w.title(), w.upper()])

    number = lambda: str(rng.randrange(10 ** rng.randint(1, 6)))
    date = lambda: f"{rng.randint(1970, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    shapes = [
        lambda: rng.choice("-_/").join(rng.choice([word, word, number])() for _ in range(rng.randint(2, 7))),
        lambda: "/" + "/".join(rng.choice([word, word, number, date])() for _ in range(rng.randint(2, 6))),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 4))) + number(),
        lambda: f"{word()}_{date()}" + rng.choice(["", "T12", f"_{number()}", f"-v{number()}"]),
        lambda: f"{word().upper()}-{rng.randint(1990, 2035)}-{rng.randrange(10**6):06}",
        lambda: "-".join(number() for _ in range(rng.randint(3, 6))) + rng.choice(["", "x", "a"]),
        lambda: rng.choice("-_=") * rng.randint(16, 60) + rng.choice(["", word(), number()]),
        lambda: word() + rng.choice(["=", "+", "/"]) + number() + rng.choice(["_", "-"]) + word(),
    ]
    out: list[bytes] = []
    while len(out) < n:
        left, value, right = rng.choice(around)[0] + rng.choice(_BEFORE), rng.choice(shapes)(), rng.choice(_AFTER) + rng.choice(around)[1]
        if len(value) >= 10:
            out += [window(left + value + right, *x) for x in _some(len(left), len(left) + len(value), 2)]
    return out


def _grid(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH) & 127


def _foreign(x: np.ndarray, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the rows get the surroundings of other runs, so that the value itself has to tell."""
    x, swap = x.copy(), rng.random(len(x)) < 0.5
    other = others[rng.integers(0, len(others), len(x))]
    for part in (slice(0, SIDE), slice(SIDE + VALUE, WIDTH)):
        x[swap, part] = other[swap, part]
    return x


def _learned(pos: np.ndarray, neg: np.ndarray, steps: int, seed: int) -> SecretModel:
    """A network without calibration."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, (2 / s[0]) ** 0.5, s)
    model = SecretModel({"embed": rng.normal(0, 0.5, (128, 8)), "conv": normal(40, 24), "conv_b": np.zeros(24), "dense": normal(72, 16), "dense_b": np.zeros(16), "out": normal(16, 1)[:, 0], "out_b": np.zeros(1)})
    m, v = ({k: np.zeros_like(a) for k, a in model.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        a, b = _foreign(pos[rng.integers(0, len(pos), 32)], neg, rng), neg[rng.integers(0, len(neg), 48)]
        y = np.append(np.ones(len(a)), np.zeros(len(b)))
        logit, kept = model.forward(np.concatenate([a, b]))
        grads = model.gradients((1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y), kept)
        rate = 0.01 if t < 0.7 * steps else 0.003
        for k, g in grads.items():
            g = g + 1e-4 * model.p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _logits(model: SecretModel, x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.forward(x[i : i + 512])[0] for i in range(0, len(x), 512))])


def _calibrated(model: SecretModel, pos: np.ndarray, neg: np.ndarray, recall: float) -> None:
    """Platt scaling on logits of findings and other runs that no network learned from; the highest threshold that recalls enough."""
    logit, y = np.concatenate([pos, neg]), np.append(np.ones(len(pos)), np.zeros(len(neg)))
    # Platt's targets keep the fit finite where the classes are apart
    target = np.where(y > 0, (len(pos) + 1) / (len(pos) + 2), 1 / (len(neg) + 2))
    slope, shift = 1.0, 0.0
    for _ in range(500):
        d = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -50, 50))) - target
        slope, shift = slope - 0.05 * (d * logit).mean() / (1 + logit.var()), shift - 0.5 * d.mean()
    slope = max(slope, 1e-3)  # more must stay likelier
    model.scale = (float(slope), float(shift))
    scaled = lambda x: 1 / (1 + np.exp(-np.clip(slope * x + shift, -50, 50)))
    found = np.sort(scaled(pos))
    model.threshold = float(found[int((1 - recall) * len(found))])
    model.report |= {"recall": float((found >= model.threshold).mean()), "false_positives": float((scaled(neg) >= model.threshold).mean())}


def train(positive: list[bytes], negative: list[bytes], recall: float = 0.98, steps: int = 400, seed: int = 7) -> SecretModel:
    """Windows of findings of one kind and of other runs -> a calibrated model. Every fifth window is kept out for calibration."""
    if min(len(positive), len(negative)) < 10:
        return SecretModel()
    pos, neg = _grid(positive), _grid(negative)
    held_p, held_n = np.arange(len(pos)) % 5 == 0, np.arange(len(neg)) % 5 == 0
    model = _learned(pos[~held_p], neg[~held_n], steps, seed)
    kept = _foreign(pos[held_p], neg[~held_n], np.random.default_rng(seed))
    _calibrated(model, _logits(model, kept), _logits(model, neg[held_n]), recall)
    return model


def train_on_kinds(kinds: dict[str, list[bytes]], negative: list[bytes], recall: float = 0.95, folds: int = 4, steps: int = 400, seed: int = 7) -> SecretModel:
    """Windows of findings by kind, and of other runs -> a model whose threshold recalls ``recall`` of the windows of kinds left out."""
    neg = _grid(negative)
    held = np.arange(len(neg)) % 5 == 0
    grids = {k: _grid(w) for k, w in kinds.items() if w}
    unseen: dict[str, np.ndarray] = {}
    others = []
    for f in range(folds):
        out = [k for i, k in enumerate(grids) if i % folds == f]
        if out and len(out) < len(grids):
            model = _learned(np.concatenate([g for k, g in grids.items() if k not in out]), neg[~held], steps, seed)
            unseen |= {k: _logits(model, grids[k]) for k in out}
            others.append(_logits(model, neg[held]))
    model = _learned(np.concatenate(list(grids.values())), neg[~held], steps, seed)
    _calibrated(model, np.concatenate(list(unseen.values())), np.concatenate(others), recall)
    least = (np.log(model.threshold / (1 - model.threshold)) if model.threshold < 1 else np.inf) - model.scale[1]
    model.report |= {f"recall of {k}": float((x * model.scale[0] >= least - 1e-9).mean()) for k, x in unseen.items()}
    model.report["false_positives of the model"] = float((_logits(model, neg[held]) * model.scale[0] >= least).mean())
    return model


def _flags(texts: pa.Array) -> list[np.ndarray]:
    doc, begin, end, digits, letters = runs(texts, 32)
    hexes = np.zeros(len(texts), bool)
    hexes[doc] = True
    boundary = pc.match_substring_regex(texts, "[0-9a-f]{32}").to_numpy(zero_copy_only=False) if hexes.any() else hexes
    return [pc.match_substring_regex(texts, _MAYBE_ASSIGN).to_numpy(zero_copy_only=False), pc.match_substring(texts, "AKIA").to_numpy(zero_copy_only=False), hexes & boundary]


def _to_points(text: str, raw_at: list[int]) -> list[int]:
    if text.isascii():
        return raw_at
    raw = text.encode()
    return [len(raw[:i].decode()) for i in raw_at]


def scan(texts: pa.Array, model: SecretModel) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, float]]]]:
    """For each text the patterns' spans (start, kind, end) and the network's (start, end, probability), in code points."""
    flags = _flags(texts)
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    more: list[list[tuple[int, int, float]]] = [[] for _ in range(len(texts))]
    for i in np.flatnonzero(np.logical_or.reduce(flags)).tolist():
        base[i] = base_spans(texts[i].as_py(), *(f[i] for f in flags))
    if model.p:
        doc, begin, end, digits, letters = runs(texts, 16)
        likely = np.flatnonzero((digits >= 2) & (letters >= 1))
        at: list[tuple[int, int, int]] = []
        best, owner, windows = [], [], []

        def judge() -> None:
            for k, p in zip(owner, model.probability(windows).tolist(), strict=True):
                best[k] = max(best[k], p)
            owner.clear()
            windows.clear()

        for i in np.unique(doc[likely]).tolist():
            text, mine = texts[i].as_py(), likely[doc[likely] == i]
            points = _to_points(text, np.stack([begin[mine], end[mine]], 1).ravel().tolist())
            for s, e in zip(points[::2], points[1::2], strict=True):
                if not any(s < y and x < e for x, _, y in base[i]):
                    at.append((i, s, e))
                    best.append(0.0)
                    for x, y in pieces(s, e):
                        owner.append(len(at) - 1)
                        windows.append(window(text, x, y))
                        if len(windows) >= 8192:
                            judge()
        judge()
        for (i, s, e), p in zip(at, best, strict=True):
            if p >= model.threshold:
                more[i].append((s, e, p))
    return base, more


def fit(docs: DataFrame, most_documents: int = 30_000, most_windows: int = 4000, recall: float = 0.95, per_document: int = 4) -> SecretModel:
    """Trains on at most ``most_windows`` windows of findings of all documents and as many of other runs:
    of ``per_document``, the least by a hash, of each of the ``most_documents`` first documents in the order of a hash
    of doc_id; and on keys and names that are made up."""
    rows = keyed_text(docs)
    chosen = rows.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents).select("doc_id", F.lit(True).alias("sampled"))
    rows = rows.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", F.coalesce("sampled", F.lit(False)).alias("sampled"))

    def run(part: pa.RecordBatch) -> dict:
        texts, found, others = part.column("text"), [], []
        flags = _flags(texts)
        spans = {i: base_spans(texts[i].as_py(), *(f[i] for f in flags)) for i in np.flatnonzero(np.logical_or.reduce(flags)).tolist()}
        for i, list_ in spans.items():
            text = texts[i].as_py()
            for s, kind, e in list_:
                start = s if kind else _ASSIGN.match(text, s).start(2)
                found += [window(text, *x) for x in _some(start, e)]
        sampled = part.column("sampled").to_numpy(zero_copy_only=False)
        if sampled.any():
            doc, begin, end, _, _ = runs(texts, 10)
            mine = np.flatnonzero(sampled[doc])
            cut = np.flatnonzero(np.diff(doc[mine])) + 1
            for group in np.split(mine, cut):
                if len(group):
                    i = int(doc[group[0]])
                    text = texts[i].as_py()
                    raw = text.encode()
                    least = sorted((xxhash.xxh3_64_intdigest(raw[b:e]), b, e) for b, e in zip(begin[group].tolist(), end[group].tolist(), strict=True))[:per_document]
                    points = _to_points(text, [x for _, b, e in least for x in (b, e)])
                    for s, e in zip(points[::2], points[1::2], strict=True):
                        if not any(s < y and x < e for x, _, y in spans.get(i, ())):
                            others += [window(text, *x) for x in _some(s, e)]
        return {"window": found + others, "secret": [True] * len(found) + [False] * len(others)}

    place = shared_dir(docs.sparkSession)
    per_chunk(rows, lambda: run, "window binary, secret boolean", _CHUNK).distinct().write.parquet(f"{place}/windows")
    windows = docs.sparkSession.read.parquet(f"{place}/windows")
    take = lambda secret: [r.window for r in windows.where(F.col("secret") == secret).orderBy(F.xxhash64("window"), "window").limit(most_windows).collect()]
    findings, others = take(True), take(False)
    remove(place)
    if len(others) < 10:
        warnings.warn(f"secret scan: {len(others)} other runs are too few to learn from; only the patterns are used", stacklevel=2)
        return SecretModel()
    names = made_up_names(others, max(400, len(others) // 2), 5)
    return train_on_kinds({"found": findings} | made_up_keys(others, 250, 3), others + names, recall)


def _join(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added (spans of the network, kind ``cnn``)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in parts:
            base, more = scan(part.column("text"), model)
            named = [[(s, KINDS[k], e) for s, k, e in b] for b in base]
            out = {f"n_{k}": [sum(x[1] == k for x in b) for b in named] for k in KINDS}
            yield out | {
                "doc_id": part.column("doc_id"),
                "base_sha256": [hashlib.sha256(_join(b).encode()).hexdigest() for b in named],
                "spans": [_join(_ordered(b, m)) for b, m in zip(named, more, strict=True)],
                "n_added": [len(m) for m in more],
            }

    return over_chunks(keyed_text(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long", _CHUNK)


def _ordered(base: list[tuple[int, str, int]], more: list[tuple[int, int, float]]) -> list[tuple[int, str, int]]:
    order = {k: i for i, k in enumerate((*KINDS, "cnn"))}
    return sorted([*base, *((s, "cnn", e) for s, e, _ in more)], key=lambda x: (x[0], order[x[1]]))


def redacted(docs: DataFrame, model: SecretModel, mark: str = "[secret]") -> DataFrame:
    """All documents with all columns; every span is replaced by ``mark`` and n_chars, if there, follows."""

    from pyspark.sql.pandas.types import to_arrow_schema

    from marlstone.llm.common import chunks

    names = to_arrow_schema(docs.schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, _CHUNK):
            texts = filled_text(batch)
            base, more = scan(texts, model)
            hit = [i for i in range(len(texts)) if base[i] or more[i]]
            if hit:
                out = {i: _masked(texts[i].as_py(), [(s, e) for s, _, e in base[i]] + [(s, e) for s, e, _ in more[i]], mark) for i in hit}
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["text"] = pa.array([out.get(i, t) for i, t in enumerate(batch.column("text").to_pylist())], pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([len(out[i]) if i in out else n for i, n in enumerate(columns["n_chars"].to_pylist())], columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays(list(columns.values()), schema=names)
            yield batch

    return docs.mapInArrow(task, docs.schema)


def _masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
