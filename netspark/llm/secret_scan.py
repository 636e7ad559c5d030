"""Secret scan: a character convolutional network over candidates in their context."""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from netspark.llm._tokens import chunks, raw, string_column

#: Characters of context on each side and of a candidate that one view of the network has, and from one view of a longer candidate to the next.
SIDE, BODY, STEP = 24, 48, 32
LENGTH = 2 * SIDE + BODY
KERNEL, FILTERS, HIDDEN = 5, 24, 24
#: Shares of secrets that the threshold must catch on held-out findings, and of findings that are held out.
RECALL, HELD_OUT = 0.99, 0.25
#: Labelled findings that are made for training if none are given.
FINDINGS = 6000
#: Shortest run of token characters with a digit, shortest one of letters of both cases, and shortest assigned value, that are candidates.
RUN, LETTERS, VALUE = 16, 20, 6
#: Characters of a secret that a view must have to be one of it, in training.
SEEN = 12
MASK = "<SECRET>"

_KEY = r"(?:token|secret|key|passw(?:or)?d|passwd|pwd|credentials?|bearer)"
_KEYS = r"(?:api|access|auth|secret|private|client|encryption|signing)?[ _-]?" + _KEY
ASSIGNED = re.compile(_KEYS + r"[\"']?\s*[:=]\s*[\"'`]?([^\s\"'`,;]{%d,})" % VALUE, re.IGNORECASE)
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.DOTALL)
#: Matches, in RE2, all that ASSIGNED and PEM match; there \s is ASCII only.
ANY = "(?i)" + _KEY + r"[\"']?[\s\x0b\x1c-\x1f\x{85}\p{Z}]*[:=]|-----BEGIN [A-Z ]*PRIVATE KEY"

_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[list((string.ascii_letters + string.digits + "+/_-=").encode())] = True
_ALPHABET = " " + string.ascii_lowercase + string.ascii_uppercase + string.digits + "_-+/=.:;,\"'`()[]{}<>@#$%&*!?|\\~^\n"
CLASSES = len(_ALPHABET) + 2  # 0 pads, the last is any other character
CLASS = {c: i + 1 for i, c in enumerate(_ALPHABET)}


def candidates(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates in order: the given runs of token characters, assigned values and private keys; of two that overlap, the longer (the first of equals). A run that ends with an assigned value begins with it, so that ``password=`` stays."""
    values = [m.span(1) for m in ASSIGNED.finditer(text)]
    begin = {b: a for a, b in values}
    spans = {*((max(a, begin.get(b, a)), b) for a, b in runs), *values, *(m.span() for m in PEM.finditer(text))}
    out: list[tuple[int, int]] = []  # in order, so that only the neighbours can overlap
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        i = bisect_left(out, (a, b))
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or b <= out[i][0]):
            out.insert(i, (a, b))
    return out


def find_candidates(column: pa.Array) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """``row, text, spans`` of the rows with candidates; spans are in characters."""
    data, offsets = raw(column)
    n = len(data)
    if not n:
        return []
    is_run = _RUN_BYTE[data]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = is_run[1:] != is_run[:-1]
    edge[cuts] = True
    edge[0] = edge[n] = True
    at = np.flatnonzero(edge)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    start, end = at[:-1], at[1:]
    upper, lower = (np.concatenate([[0], np.cumsum((data >= c) & (data < c + 26))]) for c in (65, 97))
    mixed = (end - start >= LETTERS) & (upper[end] - upper[np.minimum(start + 1, n)] >= 2) & (lower[end] - lower[start] >= 2)
    ok = is_run[start] & (end - start >= RUN) & ((digits[end] > digits[start]) | mixed)
    start, end = start[ok], end[ok]
    row = np.searchsorted(offsets, start, "right") - 1
    some = pc.match_substring_regex(column, ANY).to_numpy(zero_copy_only=False)
    runs: dict[int, list] = {int(r): [] for r in np.flatnonzero(some)}
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True):
        runs.setdefault(r, []).append((a, b))
    out = []
    for r in sorted(runs):
        text, base = column[r].as_py(), int(offsets[r])
        body = data[base : int(offsets[r + 1])].tobytes()
        spans = []
        done = chars = 0
        for a, b in runs[r]:  # runs are ASCII, so only what lies before them needs decoding
            chars += len(body[done : a - base].decode("utf-8"))
            spans.append((chars, chars + b - a))
            chars += b - a
            done = b - base
        if found := candidates(text, spans):
            out.append((r, text, found))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Classes of a candidate's characters between those of its context, a row for each view: views overlap and cover the candidate."""
    left = text[max(0, start - SIDE) : start].rjust(SIDE, "\0")
    right = text[end : end + SIDE].ljust(SIDE, "\0")
    views = [left + text[a : min(a + BODY, end)].ljust(BODY, "\0") + right for a in view_starts(start, end)]
    return np.array([[0 if c == "\0" else CLASS.get(c, CLASSES - 1) for c in v] for v in views], np.int64)


def view_starts(start: int, end: int) -> list[int]:
    """Where the views of a candidate begin; the last one ends with it."""
    return [*range(start, end - BODY, STEP), max(start, end - BODY)]


@dataclass
class Network:
    """Convolution over one-hot characters, maximum over each of context, candidate and context, two dense layers, Platt's calibration."""

    kernel: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple:
        width = LENGTH - KERNEL + 1
        conv = np.broadcast_to(self.bias, (len(x), width, FILTERS)).copy()
        for k in range(KERNEL):
            conv += self.kernel[k][x[:, k : k + width]]
        cuts = [0, SIDE, SIDE + BODY, width]
        where = np.stack([conv[:, a:b].argmax(axis=1) + a for a, b in zip(cuts, cuts[1:], strict=False)], axis=1)
        top = np.maximum(np.take_along_axis(conv, where, axis=1), 0).reshape(len(x), -1)
        hidden = np.maximum(top @ self.w1 + self.b1, 0)
        return where, top, hidden, hidden @ self.w2 + self.b2

    def probability(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + batch])[3] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def judge(self, views: list[np.ndarray]) -> np.ndarray:
        """The probability of each candidate, that of its likeliest view."""
        if not views:
            return np.zeros(0)
        p = self.probability(np.concatenate(views))
        return np.maximum.reduceat(p, np.cumsum([0, *map(len, views[:-1])]))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, seed: int = 7, recall: float = RECALL) -> Network:
    """Fit by Adam on all but the held-out findings; those calibrate the probability and set the highest threshold, but at most one half, that still catches recall of their secrets."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, rest = np.split(order, [int(len(x) * HELD_OUT)])
    net = Network(rng.normal(0, 0.1, (KERNEL, CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.15, (3 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1))
    net.kernel[:, 0] = 0
    names = ("kernel", "bias", "w1", "b1", "w2", "b2")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        rng.shuffle(rest)
        for i in range(0, len(rest), 64):
            part = rest[i : i + 64]
            xb, yb = x[part], y[part]
            where, top, hidden, z = net.forward(xb)
            dz = (1 / (1 + np.exp(-z)) - yb) / len(part)
            dh = np.outer(dz, net.w2) * (hidden > 0)
            dt = ((dh @ net.w1.T) * (top > 0)).reshape(len(part), 3, FILTERS)
            g = {"w2": hidden.T @ dz, "b2": dz.sum(keepdims=True), "w1": top.T @ dh, "b1": dh.sum(axis=0), "bias": dt.sum(axis=(0, 1)), "kernel": np.zeros_like(net.kernel)}
            rows, filters = np.arange(len(part))[:, None, None], np.arange(FILTERS)[None, None, :]
            for k in range(KERNEL):
                np.add.at(g["kernel"][k], (xb[rows, where + k], np.broadcast_to(filters, where.shape)), dt)
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * g[n]
                second[n] = 0.999 * second[n] + 0.001 * g[n] ** 2
                rate = 0.004 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(net, n, getattr(net, n) - rate * first[n] / (np.sqrt(second[n]) + 1e-8))
    z, t = net.forward(x[held])[3], y[held]
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton's method on the calibration, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        gradient = np.array([((p - t) * z).sum() + 0.1 * (a - 1), (p - t).sum()])
        hessian = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
    net.slope, net.shift = float(a), float(b)
    secret = np.sort(net.probability(x[held])[t == 1])
    net.threshold = float(min(secret[int((1 - recall) * len(secret))], 0.5)) if len(secret) else 0.5
    return net


def made_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int, int, int]]:
    """``text, start, end, label`` of made findings, and the span of what the label is about: half of them secrets of common shapes in their usual places, some within long paths, and half what is taken for them."""
    rng = random.Random(seed)
    pick = rng.choice
    hex_, b64, mixed = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits

    def rand(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(pick(alphabet) for _ in range(rng.randint(low, high or low)))

    def word() -> str:
        w = "".join(pick("the on er an ti in re ou es ha st en at sh ly ing ion ble der ge ver la ci mo ra ment eau qu ch ar os".split()) for _ in range(rng.randint(1, 4)))
        return pick([w, w, w, w.capitalize(), w + pick(".,")])

    def prose(upper: bool) -> str:
        text = " ".join(word() for _ in range(rng.randint(0, 9)))
        return text.upper() if upper else text

    def secret() -> str:
        kinds = [lambda: rand(hex_, pick([32, 40, 48, 64])), lambda: rand(b64, 24, 88) + pick(["", "=", "=="]), lambda: rand(mixed, 20, 48), lambda: pick(["AKIA", "ASIA"]) + rand(string.ascii_uppercase + string.digits, 16), lambda: pick(["ghp_", "gho_", "ghs_"]) + rand(mixed, 36), lambda: pick(["sk_live_", "sk-", "rk_live_", "pk_live_"]) + rand(mixed, 24, 48), lambda: "xox" + pick("bpa") + "-" + rand(string.digits, 10, 12) + "-" + rand(mixed, 24), lambda: "AIza" + rand(mixed + "_-", 35), lambda: "eyJ" + rand(mixed, 20, 40) + "." + "eyJ" + rand(mixed, 20, 60) + "." + rand(mixed + "_-", 30, 43), lambda: rand(mixed + "!@#$%^&*", 8, 20)]
        return pick(kinds)()

    def innocent() -> str:
        kinds = [lambda: rand(hex_, pick([32, 40, 64])), lambda: "-".join(rand(hex_, k) for k in (8, 4, 4, 4, 12)), lambda: rand(string.digits, 16, 24), lambda: "-".join(rand(string.digits, 4) for _ in range(4)), lambda: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-{rng.randint(10, 59)}", lambda: "/".join(word().strip(".,") for _ in range(4)) + "/" + rand(string.digits, 1, 6), lambda: "-".join(word().strip(".,") for _ in range(4)) + "-" + rand(string.digits, 1, 4), lambda: "_".join(word().strip(".,") for _ in range(4)) + rand(string.digits, 1, 2), lambda: "".join(word().strip(".,").capitalize() for _ in range(4)) + rand(string.digits, 1, 2), lambda: "=" * rng.randint(8, 30) + rand(string.digits, 1), lambda: "".join(word().strip(".,") for _ in range(3)) + rand(string.digits, 2, 4), lambda: "-" * rng.randint(8, 20) + rand(string.digits, 1, 4) + "-" * 8]
        return pick(kinds)()

    key = "token secret api_key apikey api-key access_token auth_token password passwd pwd client_secret private_key secret_key access_key credentials bearer signing_key".split()
    plain = "commit sha1 sha256 md5 checksum digest etag revision build hash id uuid file path order invoice phone tracking page image ref version".split()
    told = ["", "", ": ", " ", " = ", "=", "/", " #", " no. ", ' = "', " ("]
    value = ["changeme", "example", "your_token_here", "undefined", "required", "placeholder", "getenv(NAME)", "os.environ", "optional", "<redacted>", "string", "********", "${TOKEN}"]
    out = []
    for i in range(n):
        upper = rng.random() < 0.15
        if i % 2:
            body = secret()
            strong = body.startswith(("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk_live_", "sk-", "rk_live_", "pk_live_", "xox", "AIza", "eyJ"))
            lead = "" if strong and rng.random() < 0.4 else pick([str.lower, str.upper, str.capitalize])(pick(key)) + pick([" = ", "=", ": ", ":", '": ', "' : "]) + pick(['"', '"', "'", ""])
        elif rng.random() < 0.12:
            body, lead = pick(value), pick(key) + pick([" = ", "=", ": ", '": '])
        else:
            body, lead = innocent(), pick([pick(plain) + pick(told), "", "", "https://www." + word().strip(".,") + ".example/"])
            if rng.random() < 0.2:  # long paths
                body = "/".join([body, *(word().strip(".,") for _ in range(rng.randint(4, 12)))])
        if upper:
            body, lead = (body.upper(), lead.upper()) if rng.random() < 0.8 else (body, lead)
        around = ["", ""]
        if i % 2 and rng.random() < 0.1:  # a secret within a longer path
            lead = pick(["https://www." + word().strip(".,") + ".example/", "", "/"])
            around = ["/".join(word().strip(".,") for _ in range(rng.randint(1, 8))) + "/", "/" + "/".join(word().strip(".,") for _ in range(rng.randint(1, 6)))]
        before = prose(upper)
        head = before + (" " if before else "") + lead
        tail = ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + pick([" ", "\n", ", ", ". ", "!! ", "; "]) + prose(upper)
        a = len(head) + len(around[0])
        out.append((head + around[0] + body + around[1] + tail, len(head), a + len(body) + len(around[1]), i % 2, a, a + len(body)))
    return out


def labelled_views(findings: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Views of labelled findings (text, start, end, label, and if they know it the secret's own span) and whether each shows a secret."""
    x, y = [], []
    for text, start, end, label, *span in findings:
        a, b = span or (start, end)
        x.append(encode(text, start, end))
        y += [float(label and min(v + BODY, b) - max(v, a) >= min(SEEN, b - a)) for v in view_starts(start, end)]
    return np.concatenate(x), np.array(y)


def network(findings: list[tuple] | None = None) -> Network:
    """Trained on labelled findings, or on made ones."""
    return train(*labelled_views(made_findings() if findings is None else findings))


def _scored(column: pa.Array, net: Network) -> Iterator[tuple[int, str, list[tuple[int, int]], np.ndarray]]:
    """Rows with candidates, and their candidates' probabilities; private keys are certain."""
    for a, b in chunks(column):
        found = find_candidates(column.slice(a, b - a))
        if not found:
            continue
        p = net.judge([encode(text, *s) for _, text, spans in found for s in spans])
        i = 0
        for row, text, spans in found:
            own = p[i : i + len(spans)]
            i += len(spans)
            sure = np.array([text.startswith("-----BEGIN", s) for s, _ in spans])
            yield a + row, text, spans, np.where(sure, 1.0, own)


def scan(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, kind, probability, is_secret`` of every candidate of every text.

    Offsets are in characters, end exclusive; kind is the candidate's shape
    (pem, hex, key, assigned). The network sees every candidate whole, a long one in
    overlapping views of which the likeliest counts. One narrow pass; the network has a constant size.
    Null and empty texts have no candidates, null ids pass through, repeated
    rows are scanned each, very long texts are scanned whole in time that grows with their length, an empty table gives no rows, extra columns are
    ignored; a probability at the threshold is a secret.
    """
    net = net or network()
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("is_secret", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, kind, p = [], [], [], [], []
            for r, text, spans, probability in _scored(string_column(batch.column(1)), net):
                for (a, b), x in zip(spans, probability.tolist(), strict=True):
                    body = text[a:b]
                    row.append(r)
                    start.append(a)
                    end.append(b)
                    kind.append("pem" if body.startswith("-----BEGIN") else "hex" if re.fullmatch("[0-9a-fA-F]+", body) else "key" if re.fullmatch(r"[\w+/=-]+", body) else "assigned")
                    p.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(kind, pa.string()), pa.array(p, pa.float64()), pa.array([x >= net.threshold for x in p], pa.bool_())], schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, schema)


def redact(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """docs with every secret of scan() replaced by MASK and, where there is one, n_chars of changed texts set to the new length.

    All other values stay as they are, also null and empty texts, null ids and
    repeated rows; very long texts are masked whole; of an empty table comes an empty one. docs
    must have a column ``text``; others of any name pass through.
    """
    net = net or network()
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    plain = docs if docs.schema[at].dataType == T.StringType() else docs.withColumn("text", docs["text"].cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for r, text, spans, p in _scored(string_column(batch.column(at)), net):
                parts, done = [], 0
                for (a, b), x in zip(spans, p, strict=True):
                    if x >= net.threshold:
                        parts += [text[done:a], MASK]
                        done = b
                if parts:
                    changed[r] = "".join([*parts, text[done:]])
            if changed:
                columns, mask = list(batch.columns), np.zeros(len(batch), bool)
                mask[list(changed)] = True
                new = [changed[r] for r in sorted(changed)]
                columns[at] = pc.replace_with_mask(columns[at], pa.array(mask), pa.array(new, columns[at].type))
                if size is not None:
                    columns[size] = pc.replace_with_mask(columns[size], pa.array(mask), pa.array([len(x) for x in new]).cast(columns[size].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return plain.mapInArrow(run, plain.schema)
