"""Secret scans: a pattern finds candidates, a random forest removes the false positives.

The forest looks at a candidate's length, the transitions between classes of characters,
how much of it dictionary words cover, whether it looks like a path, and the words
beside it. It is trained here, on labelled findings (candidate, what stands before, what
stands after, 1 or 0); by default on half of those labelled by hand in ``findings`` and on
a generated set, bounded and seeded.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import labelled

#: Labelled findings that the default training set has.
FINDINGS, TREES, DEPTH, SEED = 6_000, 31, 10, 11
#: How often each finding labelled by hand counts in it.
WEIGHT = 8
NEAR = 48
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9+/_\-])|(?<=[:=]\s)['\"]?[^\s'\"]{8,}(?=['\"])|(?<=[:=]['\"])[^\s'\"]{8,}(?=['\"])", re.ASCII)
# A mark of assignment up to where its value starts, in quotes or not; a scheme of authorization is not the value.
ASSIGNED = re.compile(
    r"[:=]+>?[ \t]*(?:(?:bearer|basic|digest|token)[ \t]+(?=[^\s'\"]))?"
    r"(?:(?=\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)')|['\"]?(?=(?P<bare>[^\s'\"])))",
    re.ASCII | re.IGNORECASE,
)
UNBROKEN = re.compile(r"[^\s'\"]+", re.ASCII)
QUOTED = re.compile(r"[:=]\s*(['\"])(?=(?P<value>[^\s'\"]{8,})['\"])", re.ASCII)
LOGIN = re.compile(r"://[^\s/:@'\"]*:(?=(?P<value>(?:(?!://)[^\s'\"@])+)@)", re.ASCII)
BEARER = re.compile(r"\bbearer[ \t]+(?P<value>[A-Za-z0-9+/_\-.~]{8,}={0,2})", re.ASCII | re.IGNORECASE)
# Prefixes of keys that need no digit.
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?P<value>(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?:gh[pousr]_|github_pat_|sk-|[sr]k_live_|xox[abprs]-|glpat-|AIza|npm_|hf_)[A-Za-z0-9_\-]{16,})", re.ASCII)
# Words that go with secrets, and words that go with harmless strings of the same looks.
SECRET_WORDS = ("access", "api", "apikey", "auth", "authorization", "aws", "bearer", "client", "credential", "key", "login", "passphrase", "passwd", "password", "private", "pwd", "secret", "session", "token")
HARMLESS_WORDS = ("build", "changelog", "checksum", "commit", "digest", "dummy", "etag", "example", "file", "fixture", "guid", "hash", "href", "http", "https", "id", "image", "integrity", "issue", "md5", "order", "path", "phone", "placeholder", "ref", "revision", "sample", "sha1", "sha256", "sku", "test", "tracking", "url", "uuid", "version")
# Dictionary words for the coverage of a candidate.
DICTIONARY = ("account", "admin", "after", "api", "app", "array", "base", "before", "build", "button", "cache", "change", "class", "client", "code", "color", "config", "content", "core", "count", "create", "data", "date", "default", "delete", "dev", "document", "element", "error", "event", "example", "factory", "field", "file", "filter", "find", "for", "form", "format", "from", "function", "get", "group", "handler", "header", "helper", "here", "home", "http", "image", "index", "info", "input", "insert", "into", "item", "key", "label", "layout", "lib", "line", "link", "list", "load", "local", "log", "login", "main", "manager", "map", "menu", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "package", "page", "panel", "parse", "password", "path", "place", "plugin", "post", "print", "process", "product", "profile", "project", "query", "read", "record", "release", "remove", "report", "request", "resource", "response", "result", "root", "row", "sample", "script", "search", "secret", "select", "server", "service", "session", "set", "setting", "size", "sort", "source", "src", "start", "state", "static", "status", "stream", "string", "style", "system", "table", "tag", "task", "template", "test", "text", "the", "thread", "time", "title", "token", "tool", "tree", "type", "update", "upload", "user", "util", "value", "version", "view", "web", "widget", "with", "word", "write", "your")

# Parts of a name that make the value assigned to it a candidate, however short.
_NAMING = (*SECRET_WORDS, "pass", "cred")
_NAME = frozenset(string.ascii_letters + string.digits + "_-.")
_SECRET, _HARMLESS = frozenset(SECRET_WORDS), frozenset(HARMLESS_WORDS)
_COVER = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
_WORDS = re.compile(r"[a-z0-9]+")
_CLASSES = np.full(128, 4)
_CLASSES[[ord(c) for c in string.ascii_lowercase]] = 0
_CLASSES[[ord(c) for c in string.ascii_uppercase]] = 1
_CLASSES[[ord(c) for c in string.digits]] = 2
_CLASSES[[ord(c) for c in "/._-"]] = 3
_VOWELS = set("aeiouAEIOU")


def _name_before(text: str, end: int) -> tuple[int, int]:
    """Where the name before ``end`` stands, with blanks and a closing mark behind it."""
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "'\"])":
        end -= 1
    start = end
    while start and text[start - 1] in _NAME:
        start -= 1
    return start, end


def _assigned(text: str) -> list[tuple[int, int]]:
    """(start, end) of every value assigned to a name of a secret.

    A value without quotes goes to the next blank or quote, or to the next assignment beside
    it: to a name of a secret, or to any name behind ``; , &`` or the like. So values don't
    overlap, whatever the text, and all of it together takes linear time.
    """
    marks = []
    for m in ASSIGNED.finditer(text):
        start, end = _name_before(text, m.start())
        name = text[start:end].lower()
        marks.append((m, start, any(w in name for w in _NAMING), start < end and text[start - 1 : start] in tuple(";,&|?")))
    out, stop, seen, end = [], len(text), len(text), len(text)  # the text from ``seen`` on is unbroken up to ``end``
    for m, start, secret, apart in reversed(marks):
        if secret and m.lastgroup != "bare":
            out.append(m.span(m.lastgroup))
        elif secret:
            a = m.start("bare")
            upto = UNBROKEN.match(text, a, seen).end()
            seen, end = a, end if upto == seen else upto
            b = min(end, stop)
            if a < b:
                b = a + len(text[a:b].rstrip(",;.&" if b == stop else ",;."))
            if a < b:
                out.append((a, b))
        if secret or apart:
            stop = start
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate, in order; they may overlap."""
    out = set()
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        a += text[a] in "'\""
        if b - a >= 8:
            out.add((a, b))
    for pattern in (QUOTED, LOGIN, BEARER, PREFIXED):
        out.update(m.span("value") for m in pattern.finditer(text))
    out.update(_assigned(text))
    return sorted(out)


@functools.lru_cache(maxsize=1 << 14)
def features(candidate: str, before: str, after: str) -> tuple[float, ...]:
    """What the forest sees of a finding."""
    raw = np.frombuffer(candidate.encode("ascii", "replace"), np.uint8)
    kinds, n = _CLASSES[raw], len(raw)
    moves = np.bincount(kinds[:-1] * 5 + kinds[1:], minlength=25) / max(1, n - 1)
    counts = np.bincount(raw, minlength=128)
    p = counts[counts > 0] / n
    lower = candidate.lower()
    covered = sum(len(m) for m in _COVER.findall(lower)) / n
    left, right = _WORDS.findall(before.lower())[-4:], _WORDS.findall(after.lower())[:2]
    runs = max((m.end() - m.start() for m in re.finditer(r"(.)\1*", lower)), default=0)
    return (
        n, float(-(p * np.log2(p)).sum()), (kinds[:-1] != kinds[1:]).sum() / max(1, n - 1), *moves, *(np.bincount(kinds, minlength=5) / n), covered,
        sum(c in _VOWELS for c in candidate) / n, len(set(lower)) / n, runs / n,
        candidate.count("/"), candidate.count("."), candidate.count("-"), candidate.count("_"), float(before.rstrip().endswith(("/", "://"))), float("/" in candidate or "\\" in candidate),
        float(bool(re.fullmatch(r"[0-9a-f]+", lower))), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", lower))), float(candidate.isdigit()),
        sum(w in _SECRET for w in left), sum(w in _HARMLESS for w in left), float(bool(left) and left[-1] in _SECRET), float(bool(left) and left[-1] in _HARMLESS), sum(w in _HARMLESS for w in right),
        float(bool(re.search(r"[=:]\s*['\"]?$", before))), float(before.endswith(('"', "'"))), float(after.startswith(('"', "'"))),
        float(bool(PREFIXED.match(candidate))), float(bool(re.search(r"://[^\s/:@]*:$", before)) and after.startswith("@")), float(candidate.isalpha()), float(bool(re.search(r"[(){}<>\[\]$/\s]|\*\*|\.\w+\.", candidate))),
    )


def generated_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, before, after, label): n labelled findings by rule, the same for the same seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexa, full = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: pick(DICTIONARY)
    filler = lambda k=3: " ".join(pick((word(), draw("aeinorst", int(rng.integers(2, 9))))) for _ in range(int(rng.integers(0, k + 1))))

    def secret() -> str:
        kind = int(rng.integers(6))
        if kind == 0:
            return draw(hexa, pick((32, 40, 48, 64)))
        if kind == 1:
            return pick(("AKIA", "ASIA")) + draw(string.ascii_uppercase + string.digits, 16)
        if kind == 2:
            return pick(("ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-")) + draw(full, int(rng.integers(20, 40)))
        if kind == 3:
            return draw(full + "+/", pick((32, 40, 43, 64))) + pick(("", "=", "=="))
        return draw(full, int(rng.integers(16, 48)))

    def password() -> str:
        kind = int(rng.integers(4))
        if kind == 0:
            return draw(full + "!@#%^&*-_+?", int(rng.integers(8, 24)))
        if kind == 1:
            return pick((str.title, str.lower))(draw("abcdefghijklmnoprstuvwxyz", int(rng.integers(4, 11)))) + draw(string.digits, int(rng.integers(1, 5))) + pick(("", "!", "&", "$", "#", "?", "&3x", "!Pass"))
        if kind == 2:
            w = word() + draw(string.digits, int(rng.integers(1, 4)))
            return pick((w + w, w.title() + pick("!@#%&*") + word(), w + pick("!@#%&*")))
        w = draw("abcdefghijklmnoprstuvwxyz", int(rng.integers(5, 10)))
        return w.replace("a", "4").replace("o", "0").replace("e", "3") + draw(string.digits, 1) + pick(("", "&3x", "!", "x"))

    def shown() -> tuple[str, str]:
        """A secret where its context, not its looks, tells."""
        kind = int(rng.integers(4))
        if kind == 0:
            return password(), pick(("password", "passwd", "pwd", "passphrase", "db_password", "secret", "login")) + pick(("=", ": ", " = ", " =  ", ":"))
        if kind == 1:
            return pick((password(), draw(full, int(rng.integers(8, 24))))), f"{pick(('postgres', 'mysql', 'https', 'amqp', 'redis'))}://{pick((word(), draw('aeinorst', 5)))}:"
        if kind == 2:
            return draw(string.ascii_letters, int(rng.integers(14, 40))), pick(("authorization: bearer ", "bearer ", "auth token: ", "authorization: basic "))
        return pick((pick(("AKIA", "ASIA")) + draw(string.ascii_uppercase, 16), pick(("ghp_", "sk-", "glpat-")) + draw(string.ascii_letters, 30))), pick((f"{pick(SECRET_WORDS)}_id=", f"{pick(SECRET_WORDS)}: ", ""))

    def spoken() -> tuple[str, str]:
        """What follows the name of a secret, or stands in a URL, and is none."""
        kind = int(rng.integers(5))
        before = pick(SECRET_WORDS) + pick((": ", "=", " = ", ":"))
        if kind == 0:
            return pick((word(), draw("aeinorsthl", int(rng.integers(2, 9))), word().title(), "None", "null", "true", "required", "string", "str", "Bearer")), before
        if kind == 1:
            return pick((f"os.environ[{word()}]", f"get_{word()}()", f"self.{word()}.{word()}", f"{word()}.{word()}", f"${{{word().upper()}}}", f"<{word()}>", f"{{{word()}}}", f"{word()}({word()})", f"{word()}_{word()}")), before
        if kind == 2:
            return pick(("*", "x", ".", "0", "-")) * int(rng.integers(2, 13)), before
        if kind == 3:
            return draw(string.digits, int(rng.integers(1, 5))), before
        return pick((f"{draw(string.digits, 4)}/{word()}", f"{draw(string.digits, 4)}/{word()}/{word()}")), f"http://{word()}:"

    def harmless() -> tuple[str, str]:
        kind = int(rng.integers(9))
        if kind == 0:
            h = draw(hexa, 32)
            return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), pick(("uuid ", "id: ", 'guid="', ""))
        if kind == 1:
            return draw(hexa, pick((32, 40, 64))), pick(("commit ", "sha1: ", "revision ", "checksum ", "sha256 ", "md5 ", 'integrity="', "etag "))
        if kind == 2:
            return "/".join(word() for _ in range(int(rng.integers(3, 7)))) + f"/{word()}{rng.integers(100)}", pick(("path ", "file: ", "https://", "src=", 'href="', ""))
        if kind == 3:
            return "".join(word().title() for _ in range(4)) + str(rng.integers(1000)), pick(("class ", "import ", "", "test "))
        if kind == 4:
            return "_".join(word() for _ in range(int(rng.integers(3, 6)))) + f"_{rng.integers(100)}", pick(("key: ", "token = ", "", "set "))
        if kind == 5:
            return pick(("your_api_key_here_0", "xxxxxxxxxxxxxxxxxxxx1", "0000000000000000000000", "example-token-12345678", "insert_your_secret_key_1", "changeme123changeme123")), pick(("token = ", 'api_key = "', "secret: ", "password="))
        if kind == 6:
            return draw(string.digits, int(rng.integers(16, 24))), pick(("order ", "phone ", "tracking ", "", "card "))
        if kind == 7:
            return f"{word()}-{rng.integers(10)}-{rng.integers(100)}-{word()}-{word()}-{rng.integers(2000)}", pick(("version ", "build ", "file ", "image "))
        return "".join(draw("aeinorsthl", int(rng.integers(3, 8))) for _ in range(4)) + str(rng.integers(100)), pick(("", "the ", "and "))

    out = []
    for i in range(n):
        if i % 2:
            name = pick(SECRET_WORDS) + pick(("", "_" + pick(SECRET_WORDS)))
            quote = pick(('"', '"', "'", ""))
            before = f"{filler()} {name}{pick((' = ', '=', ': ', ' '))}{quote}" if rng.random() < 0.9 else filler() + " "
            found, label = secret(), 1
            if rng.random() < 0.4:
                found, before = shown()
                before, quote = f"{filler()} {before}", "@" if "://" in before else ""
                if not quote and before.endswith(("=", "= ", ": ")) and rng.random() < 0.4:
                    quote = pick("'\"")
                    before += quote
            if rng.random() < 0.25:
                found, before = found.upper(), before.upper()
        else:
            found, before = harmless() if rng.random() < 0.6 else spoken()
            before, quote, label = f"{filler()} {before}", '"' if before.endswith('"') else "@" if "http://" in before else "", 0
            if rng.random() < 0.25:
                found, before = found.upper(), before.upper()
        out.append((found, before[-NEAR:], (quote + pick((" ", "\n", "; ", ", ", ".")) + filler())[:NEAR], label))
    return out


class Forest:
    """Binary decision trees as arrays; grown on bootstrap samples with random subsets of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._tree(x, y, rng.integers(0, len(x), len(x)), depth, rng) for _ in range(trees)]

    @staticmethod
    def _tree(x, y, rows, depth, rng):
        nodes: list[list[float]] = []

        def grow(at, left_depth) -> int:
            share = y[at].mean()
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, share])
            if left_depth == 0 or len(at) < 8 or share in (0, 1):
                return me
            best = (0.0, -1, 0.0)
            gini = share * (1 - share)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                v = x[at, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12), method="lower"))
                for c in cuts:
                    low = v <= c
                    k = low.sum()
                    if 0 < k < len(at):
                        p, q = y[at[low]].mean(), y[at[~low]].mean()
                        gain = gini - (k * p * (1 - p) + (len(at) - k) * q * (1 - q)) / len(at)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c)
            if best[1] < 0:
                return me
            low = x[at, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(at[low], left_depth - 1)
            nodes[me][3] = grow(at[~low], left_depth - 1)
            return me

        grow(rows, depth)
        return np.array(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                f = t[at, 0].astype(int)
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(low, t[at, 2], t[at, 3]).astype(int), at)
            total += t[at, 4]
        return total / len(self.trees)


@functools.lru_cache(maxsize=2)
def default_forest() -> Forest:
    """Of generated findings and the half of those labelled by hand that is not held out."""
    return trained(generated_findings() + labelled(held_out=False) * WEIGHT)


def trained(findings) -> Forest:
    """A forest from labelled findings: (candidate, before, after, label)."""
    x = np.array([features(c, b, a) for c, b, a, _ in findings], float)
    return Forest(x, np.array([y for *_, y in findings], float))


def find(texts: list[str | None], forest: Forest, least: float = 0.5) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """For each text: how many candidates, and (start, end, score) of those that score ``least`` or more."""
    spans, rows, owner = [], [], []
    for i, t in enumerate(texts):
        for a, b in candidates(t or ""):
            spans.append((a, b))
            owner.append(i)
            rows.append(features(t[a:b], t[max(0, a - NEAR) : a], t[b : b + NEAR]))
    scores = forest.score(np.array(rows, float)) if rows else []
    counts, out = [0] * len(texts), [[] for _ in texts]
    for i, (a, b), s in zip(owner, spans, scores):
        counts[i] += 1
        if s >= least:
            found = out[i]
            if found and a < found[-1][1]:  # overlapping ones are one secret
                a, b, s = found[-1][0], max(b, found[-1][1]), max(s, found.pop()[2])
            found.append((a, b, float(s)))
    return list(zip(counts, out))


def scan(docs: DataFrame, findings=None) -> DataFrame:
    """One row a document: doc_id, n_candidates, n_secrets, secrets (start, end, score; in characters).

    ``findings``: labelled ones to train on, else the default ones. Null and empty texts
    have none. Repeated rows are scanned alike. Empty table: no rows.
    """
    forest = trained(findings) if findings is not None else default_forest()

    def run(batches):
        for b in batches:
            found = find(b.column("text").to_pylist(), forest)
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in x] for _, x in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array(spans, kind)], ["doc_id", "n_candidates", "n_secrets", "secrets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start:int,end:int,score:double>>")


MARK = "<secret>"


def redact(docs: DataFrame, findings=None) -> DataFrame:
    """``docs`` with each secret of ``text`` replaced by ``MARK``; other texts and columns stay as they are.

    Null and empty texts stay so. Rows that repeat an id are each redacted for themselves.
    Columns may have any name; the only one read is ``text``. Empty table: no rows.
    """
    forest = trained(findings) if findings is not None else default_forest()

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = b.column(at).to_pylist()
            for i, (_, spans) in enumerate(find(texts, forest)):
                for s, e, _ in reversed(spans):
                    texts[i] = texts[i][:s] + MARK + texts[i][e:]
            yield b.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
