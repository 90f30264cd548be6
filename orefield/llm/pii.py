"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) stand as found. The labelers judge them and further candidates alike; expectation-
maximisation over the counts of vote patterns estimates each labeler's reliability and each pattern's posterior, and a
logistic classifier over the spans' own features learns from these posteriors. Further candidates that it accepts are
added: national phone numbers, secrets, and numbers like cards. Counts of patterns and features are bounded tables.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.arrow import map_texts
from orefield.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("national_phone", "secret", "number")
KINDS = BASE_KINDS + MORE_KINDS

# The patterns of the contract. IP runs start where no digit stands before, as every match does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NATIONAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}")

# Gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es eu uk us co".split())
CALLING_CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "351", "46", "47", "48", "61", "81", "86", "91")
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6", "35", "2")
SECRET_WORDS = ("token", "secret", "password", "passwd", "key", "api", "bearer", "auth")
FOR = {
    "email": ("mail", "contact", "write", "@", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "ruf"),
    "national_phone": ("call", "phone", "tel", "fax", "mobile", "ruf"),
    "secret": SECRET_WORDS,
    "number": ("card", "account", "iban", "konto", "compte", "cuenta"),
}
AGAINST = ("version", "isbn", "page", "figure", "table", "rfc", "build", "release", "order", "ticket", "price")
LABELERS = ("regex", "gazetteer", "context", "checksum")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them from left to right, but starting from each @, so runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(map(small_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 13 <= len(digits) <= 19:
            found["card" if luhn(digits) else "number"].append(m.span())
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans and further candidates; a further candidate doesn't overlap a base span or an earlier kind."""
    found = base_spans(text)
    taken = sorted(s for k in BASE_KINDS for s in found[k])
    for kind, matches in (("national_phone", NATIONAL.finditer(text)), ("secret", SECRET.finditer(text))):
        found[kind] = [m.span() for m in matches]
    for kind in MORE_KINDS:
        starts = [a for a, _ in taken]
        reach = list(accumulate((b for _, b in taken), max))
        free = []
        for a, b in found[kind]:
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                free.append((a, b))
        found[kind] = free
        taken = sorted(taken + free)
    return found


def votes(kind: str, text: str, a: int, b: int) -> list[int]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for no opinion."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    digits = digits_of(span)
    if kind == "email":
        gaz = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else -1
        shape = 1 if b - a <= 254 and ".." not in span else -1
    elif kind == "ip":
        gaz = -1 if span.startswith(("0.", "127.", "255.")) else 1
        shape = 1 if all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
    elif kind in ("card", "number"):
        gaz = 1 if digits.startswith(CARD_STARTS) else -1
        shape = 1 if luhn(digits) else -1
    elif kind in ("phone", "national_phone"):
        gaz = (1 if digits.startswith(CALLING_CODES) else -1) if kind == "phone" else 0
        shape = 1 if 9 <= len(digits) <= 13 else -1
    else:
        gaz = 1 if any(w in before for w in SECRET_WORDS) else -1
        shape = 1 if len(set(span)) >= 10 and len(digits) >= 4 else -1
    near = 1 if any(w in before for w in FOR[kind]) else -1 if any(w in before for w in AGAINST) else 0
    strict = 1 if kind in BASE_KINDS else (1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9_-]{32,}", span) else -1) if kind == "secret" else 1 if kind == "national_phone" else 0
    return [strict, gaz, near, shape]


FEATURES = (
    [f"kind={k}" for k in KINDS]
    + [f"length={x}" for x in range(6)]
    + [f"digits={x}" for x in range(5)]
    + [f"letters={x}" for x in range(5)]
    + [f"before={x}" for x in "wsqo"]
    + [f"after={x}" for x in "wsqo"]
    + ["assigned"]
)
NUMBER_OF = {f: i for i, f in enumerate(FEATURES)}


def _class(c: str) -> str:
    return "w" if c.isalnum() else "s" if c.isspace() or not c else "q" if c in "\"'`" else "o"


def features(kind: str, text: str, a: int, b: int) -> list[int]:
    """Numbers of the span's features; every feature has few values, so their combinations are a bounded table."""
    span = text[a:b]
    n = len(span)
    names = [
        f"kind={kind}",
        f"length={min(5, n // 8)}",
        f"digits={4 * sum(c.isdigit() for c in span) // n}",
        f"letters={4 * sum(c.isalpha() for c in span) // n}",
        f"before={_class(text[a - 1 : a])}",
        f"after={_class(text[b : b + 1])}",
    ]
    if re.search(r"[=:]\s*[\"']?$", text[max(0, a - 4) : a]):
        names.append("assigned")
    return [NUMBER_OF[x] for x in names]


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPAN = "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>,features:array<int>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_sha256, spans with votes and features), a row for each row of docs."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
    )

    def make():
        some = re.compile(rb"[0-9@]")
        nothing = hashlib.sha256(b"").hexdigest()

        def work(texts, _):
            shas, lists = [], []
            for data in texts:
                if not some.search(data):
                    shas.append(nothing)
                    lists.append([])
                    continue
                text = data.decode("utf-8", "replace")
                found = spans_of(text)
                base = [(k, a, b) for k in BASE_KINDS for a, b in found[k]]
                shas.append(hashlib.sha256(told(base).encode()).hexdigest())
                lists.append(
                    [{"kind": k, "start": a, "end": b, "votes": votes(k, text, a, b), "features": features(k, text, a, b)} for k in KINDS for a, b in found[k]]
                )
            return {"base_sha256": shas, "cands": pa.array(lists, type=kind)}

        return work

    return map_texts(docs, {"doc_id": f"`{id_col}`"}, f"base_sha256 string, cands {SPAN}", make, text_col)


def reliabilities(patterns: Counter, rounds: int = 100) -> tuple[dict[str, float], np.ndarray, dict]:
    """EM over counts of (kind, votes): a prior for each kind, P(vote | class) for each labeler, posteriors.

    Starts from the majority of the votes; the classes stay named by it, as each labeler starts better than chance.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    kinds = sorted({k for k, _ in keys})
    kind = np.array([kinds.index(k) for k, _ in keys], dtype=np.int64)
    vote = np.array([v for _, v in keys], dtype=np.int64).reshape(-1, len(LABELERS)) + 1
    post = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
    prior, table = np.full(len(kinds), 0.5), np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(rounds):
        for i in range(len(kinds)):
            own = kind == i
            prior[i] = ((n * post)[own].sum() + 1) / (n[own].sum() + 2)
        for c, weight in enumerate((n * (1 - post), n * post)):
            for j in range(len(LABELERS)):
                # a few made-up votes: labelers err towards their opinion only so far
                start = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]][c])
                counts = np.bincount(vote[:, j], weights=weight, minlength=3) + start
                table[c, j] = counts / counts.sum()
        logs = [np.log(table[c, np.arange(len(LABELERS)), vote]).sum(axis=1) for c in (0, 1)]
        odds = np.log(prior[kind]) - np.log1p(-prior[kind]) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(kinds, prior.tolist())), table, dict(zip(keys, post.tolist()))


def train(table: dict[tuple[int, ...], tuple[float, float]], ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) of a logistic classifier from feature combination -> (spans, sum of posteriors)."""
    if not table:
        return np.zeros(len(FEATURES) + 1)
    x = np.zeros((len(table), len(FEATURES) + 1))
    x[:, -1] = 1
    for i, f in enumerate(table):
        x[i, list(f)] = 1
    n, y = np.array([v for v in table.values()]).T
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * p - y) + ridge * w
        hessian = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_spans, n_email, ..., n_number, base_sha256, found array<struct<kind,start,end,p>>, spans).

    n_spans counts all spans, the n_ of each kind its own. A row for each row of docs. Null and empty texts have no spans. Repeated rows are told alike and count as often in
    the estimates. Base spans are always found, further candidates where the classifier gives p >= ``threshold``.
    """
    seen = materialize(candidates(docs, id_col, text_col), "spans")
    each = seen.select(F.explode("cands").alias("c"))
    counted = each.groupBy("c.kind", "c.votes", "c.features").count().collect()  # at most 7 * 81 * feature combinations
    patterns = reduce(lambda a, r: a.update({(r[0], tuple(r[1])): r[3]}) or a, counted, Counter())
    _, _, posterior = reliabilities(patterns) if patterns else ({}, None, {})
    table: dict[tuple[int, ...], tuple[float, float]] = {}
    for kind, v, f, n in counted:
        a, b = table.get(tuple(f), (0.0, 0.0))
        table[tuple(f)] = (a + n, b + n * posterior[kind, tuple(v)])
    weights = F.array(*(F.lit(float(x)) for x in train(dict(sorted(table.items())))))
    last = len(FEATURES)

    def p(c):
        return 1 / (1 + F.exp(-F.aggregate(c["features"], F.get(weights, F.lit(last)), lambda s, f: s + F.get(weights, f))))

    scored = F.transform("cands", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), p(c).alias("p")))
    found = F.filter(scored, lambda c: c["kind"].isin(list(BASE_KINDS)) | (c["p"] >= threshold))
    rows = seen.select("doc_id", "base_sha256", found.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = F.array_join(F.transform("found", lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
    total = F.size("found").cast("long").alias("n_spans")
    return rows.select("doc_id", total, *map(count, KINDS), "base_sha256", "found", listed.alias("spans"))
