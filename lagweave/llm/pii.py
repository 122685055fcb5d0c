"""Personal data: base patterns, and spans added by a character-level bidirectional LSTM with a CRF.

The tagger is trained in numpy on windows of documents whose spans the base patterns label. It is run
over overlapping windows about words that hold a digit or an at sign: every kind of span has one, so other
windows cannot hold any. Tags of overlapping windows are joined, each position's from the window it is most
central in, so that spans of any length are whole; spans that one window sees whole are taken too, the
longest of overlapping ones first. Base spans always stay; the tagger only adds spans
that overlap none of them, and only if they hold what their kind must (a checked number, say). A run of
words tagged as one that holds it only in parts, such as two cards side by side, is taken apart.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Documents (drawn by a hash of the id) and windows that the tagger is trained on, at most.
TRAIN_DOCS, TRAIN_WINDOWS = 4000, 1500
WINDOW, STRIDE, HIDDEN, STEPS, BATCH = 64, 32, 12, 120, 64
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_OTHER, _PAD = 15, 16
N_CLASSES = 17
_SPACE, _LINE = 10, 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    """Leftmost non-overlapping matches of the email pattern, from each at sign outwards, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list, list]:
    """(kind, start, end) of valid base spans by kind and start, and of every base match, valid or not."""
    good, every = [], []
    if not _ANCHOR.search(text):
        return good, every
    for s, e in _emails(text):
        good.append((0, s, e))
        every.append((0, s, e))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            found = m[0]
            if kind == 1:
                ok = all(_small(p) for p in found.split("."))
            else:
                n = len(found) if len(found) > 64 else len(_digits(found))
                ok = (13 <= n <= 19 and _luhn(_digits(found))) if kind == 2 else 9 <= len(_digits(found)) <= 15
            every.append((kind, m.start(), m.end()))
            if ok:
                good.append(every[-1])
    return good, every


def _class_table() -> np.ndarray:
    table_ = np.full(256, _OTHER, np.int8)
    table_[ord("0") : ord("9") + 1] = 0
    table_[ord("a") : ord("z") + 1] = 1
    table_[ord("A") : ord("Z") + 1] = 2
    table_[192:256] = 3
    for i, c in enumerate("@.-+() _%\n", 4):
        table_[ord(c)] = i
    table_[ord(",")] = 14
    return table_


_CLASS = _class_table()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _CLASS[np.minimum(points, 255)], 3)


def window_starts(cls: np.ndarray) -> np.ndarray:
    """Starts (multiples of STRIDE) of the windows that hold a part of a word with a digit or an at sign."""
    anchors = (cls == 0) | (cls == 4)
    word = np.cumsum((cls == _SPACE) | (cls == _LINE))  # number of the word of each position; its first is the space before it
    last = np.flatnonzero(np.isin(word, word[anchors])) // STRIDE
    return np.unique(np.r_[last, np.maximum(last - 1, 0)]) * STRIDE


def _windows(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.r_[cls, np.full(WINDOW, _PAD, cls.dtype)]
    return padded[starts[:, None] + np.arange(WINDOW)]


class Tagger:
    """Bidirectional LSTM over character classes, with emissions for a linear-chain CRF."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h, k = HIDDEN, TAGS
        self.p = {}
        for d in "fb":
            self.p |= {d + "x": r.normal(0, 0.3, (N_CLASSES, 4 * h)), d + "u": r.normal(0, 0.3, (h, 4 * h)), d + "c": np.zeros(4 * h)}
        self.p |= {"w": r.normal(0, 0.3, (2 * h, k)), "e": np.zeros(k), "a": np.zeros((k, k)), "s": np.zeros(k)}

    def _run(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        p, h = self.p, HIDDEN
        n, t_ = x.shape
        out, memo = np.zeros((n, t_, h)), []
        hid, cell = np.zeros((n, h)), np.zeros((n, h))
        for t in range(t_) if d == "f" else range(t_ - 1, -1, -1):
            z = p[d + "x"][x[:, t]] + hid @ p[d + "u"] + p[d + "c"]
            gate = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o, g = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :], np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            th = np.tanh(new)
            memo.append((t, hid, cell, i, f, o, g, th))
            hid, cell = o * th, new
            out[:, t] = hid
        return out, memo

    def _back(self, d: str, x: np.ndarray, memo: list, dout: np.ndarray, grad: dict) -> None:
        p, h = self.p, HIDDEN
        dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        gx, gu, gc = np.zeros_like(p[d + "x"]), np.zeros_like(p[d + "u"]), np.zeros_like(p[d + "c"])
        for t, hid, cell, i, f, o, g, th in reversed(memo):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - th**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            np.add.at(gx, x[:, t], dz)
            gu += hid.T @ dz
            gc += dz.sum(0)
            dh, dc = dz @ p[d + "u"].T, dc * f
        grad |= {d + "x": gx, d + "u": gu, d + "c": gc}

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
        f, fm = self._run("f", x)
        b, bm = self._run("b", x)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["w"] + self.p["e"], both, fm, bm

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y and its gradient, by the forward-backward algorithm."""
        n, t_ = x.shape
        em, both, fm, bm = self.emissions(x)
        a, s = self.p["a"], self.p["s"]

        def lse(v, axis):
            m = v.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = s + em[:, 0]
        for t in range(1, t_):
            alpha[:, t] = em[:, t] + lse(alpha[:, t - 1][:, :, None] + a, 1)
        for t in range(t_ - 2, -1, -1):
            beta[:, t] = lse(a + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)
        gold = s[y[:, 0]] + em[rows[:, None], np.arange(t_), y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows[:, None], np.arange(t_), y] -= 1
        ga = np.zeros_like(a)
        for t in range(1, t_):
            ga += np.exp(alpha[:, t - 1][:, :, None] + a + (em[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(ga, (y[:, :-1], y[:, 1:]), 1)
        de /= n
        grad = {"a": ga / n, "s": de[:, 0].sum(0), "e": de.sum((0, 1)), "w": np.einsum("nth,ntk->hk", both, de)}
        dboth = de @ self.p["w"].T
        self._back("f", x, fm, dboth[:, :, :HIDDEN], grad)
        self._back("b", x, bm, dboth[:, :, HIDDEN:], grad)
        return float((z - gold).mean()), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.03, seed: int = 6) -> float:
        r = np.random.default_rng(seed)
        m, v, loss = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0.0
        for n in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            loss, grad = self.step(x[pick], y[pick])
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags of each window (Viterbi)."""
        em = self.emissions(x)[0]
        n, t_, k = em.shape
        best, back = self.p["s"] + em[:, 0], np.zeros((n, t_, k), np.int8)
        for t in range(1, t_):
            score = best[:, :, None] + self.p["a"]
            back[:, t] = score.argmax(1)
            best = em[:, t] + score.max(1)
        tags = np.zeros((n, t_), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(t_ - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags


def _tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(tags):
        t = int(tags[i])
        if t:
            kind, j = (t - 1) // 2, i + 1
            while j < len(tags) and tags[j] == 2 + 2 * kind:
                j += 1
            out.append((kind, i, j))
            i = j
        else:
            i += 1
    return out


def reconciled(spans: list[tuple[int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) without overlaps from (window start, kind, start, end) of overlapping windows.

    A span at the edge of its window counts only if the text ends there too; of spans that overlap, the
    one farthest from its window's edges stays, then the longer, then the first.
    """
    whole = []
    for w, kind, s, e in spans:
        if (s == w and w > 0) or (e == w + WINDOW and e < length):
            continue
        room = min(s - w if w else WINDOW, w + WINDOW - e if w + WINDOW < length else WINDOW)
        whole.append((-room, s - e, s, kind, min(e, length)))
    out: list[tuple[int, int, int]] = []
    for _, _, s, kind, e in sorted(set(whole)):
        if s < e and not any(s < e2 and s2 < e for _, s2, e2 in out):
            out.append((kind, s, e))
    return sorted(out, key=lambda x: x[1])


def joined(starts: np.ndarray, tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans in the tags of windows in order, each position's from the window it is most central in."""
    out, margin = [], (WINDOW - STRIDE) // 2
    for run in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts) != STRIDE) + 1):
        first, last = starts[run[0]], starts[run[-1]]
        line = np.zeros(last - first + WINDOW, tags.dtype)
        for i in run:
            a = 0 if i == run[0] else margin
            line[starts[i] - first + a : starts[i] - first + WINDOW] = tags[i, a:]
        out += [(k, int(first) + s, int(first) + e) for k, s, e in _tag_spans(line)]
    return out


def _holds(kind: int, found: str) -> bool:
    digits = _digits(found)
    if kind == 0:
        name, _, domain = found.partition("@")
        return bool(name and "." in domain.strip(".") and "@" not in domain and not re.search(r"\s", found))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(_small(p) for p in parts)
    return (13 <= len(digits) <= 19 and _luhn(digits)) if kind == 2 else 9 <= len(digits) <= 15


def held_parts(kind: int, text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of what holds `kind` in a tagged span: from the left, the most words in a row that do."""
    words, out, i = [(m.start(), m.end()) for m in re.compile(r"\S+").finditer(text, start, end)], [], 0
    while i < len(words):
        at, numbers = 0, 0
        for j in range(i, len(words)):
            if _ANCHOR.search(text, *words[j]):
                numbers += 1
                if numbers > 19:  # no kind has more digits, so none has more words with one
                    break
                if _holds(kind, text[words[i][0] : words[j][1]]):
                    at = j + 1
        if at:
            out.append((words[i][0], words[at - 1][1]))
        i = at or i + 1
    return out


def _labelled_windows(batches):
    for batch in batches:
        ids, xs, ys = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cls = classes(text or "")
            starts = window_starts(cls)
            if not len(starts):
                continue
            tags = np.zeros(len(cls) + WINDOW, np.int8)
            good, every = base_spans(text)
            # Matches that fail as a whole are labelled where parts of them hold, else the tagger would learn to leave those out.
            parts = [(k, *p) for k, s, e in set(every).difference(good) for p in held_parts(k, text, s, e)]
            for kind, s, e in [*sorted(good, key=lambda x: x[1] - x[2]), *sorted(parts)]:
                if not tags[s:e].any():
                    tags[s:e] = 2 + 2 * kind
                    tags[s] = 1 + 2 * kind
            x, y = _windows(cls, starts), tags[starts[:, None] + np.arange(WINDOW)]
            ids += [f"{doc}:{s}" for s in starts]
            xs += x.tolist()
            ys += y.tolist()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(xs, pa.list_(pa.int32())), pa.array(ys, pa.list_(pa.int32()))], names=["id", "x", "y"])


def train_tagger(docs: DataFrame, id_col: str, text_col: str) -> Tagger:
    """A tagger fitted on at most TRAIN_WINDOWS windows of at most TRAIN_DOCS documents, drawn by hash."""
    chosen = docs.select(F.col(id_col).alias("_doc")).filter("_doc IS NOT NULL").distinct().orderBy(F.xxhash64("_doc"), "_doc").limit(TRAIN_DOCS)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("_doc")).select("doc", "text")
    got = rows.mapInArrow(_labelled_windows, "id string, x array<int>, y array<int>").orderBy(F.xxhash64("id"), "id").limit(TRAIN_WINDOWS).collect()
    tagger = Tagger()
    if got:
        tagger.fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))
    return tagger


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row per input row: id_col, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all, kind:start:end).

    Offsets count code points, ends are exclusive. Null texts are empty and, like texts without spans, have
    zero counts, the digest of the empty string and empty spans. Repeated rows are repeated; an empty table
    gives an empty result. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((tagger or train_tagger(docs, id_col, text_col)).p)

    def run(batches):
        tag = Tagger()
        tag.p = model.value
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            found = [base_spans(t or "")[0] for t in texts]
            windows, where = [], []
            for i, t in enumerate(texts):
                if t and _ANCHOR.search(t):
                    cls = classes(t)
                    starts = window_starts(cls)
                    windows.append(_windows(cls, starts))
                    where += [(i, int(s)) for s in starts]
            raw: dict[int, list] = {}
            of_doc: dict[int, list] = {}
            if windows:
                # Equal windows are decoded once.
                x, back = np.unique(np.concatenate(windows).astype(np.int8), axis=0, return_inverse=True)
                tags = np.concatenate([tag.decode(x[j : j + 512]) for j in range(0, len(x), 512)])
                some = tags.any(axis=1)
                for (i, s), b in zip(where, back.ravel(), strict=True):
                    of_doc.setdefault(i, []).append((s, b))
                    if some[b]:
                        raw.setdefault(i, []).extend((s, k, s + p, s + q) for k, p, q in _tag_spans(tags[b]))
            for i, (doc, t) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                base = found[i]
                more = []
                if i in raw:
                    starts, which = zip(*of_doc[i], strict=True)
                    tagged = {*reconciled(raw[i], len(t)), *((k, s, min(e, len(t))) for k, s, e in joined(np.array(starts), tags[list(which)]))}
                    held = {(k, s, e) for k, a, b in tagged for s, e in held_parts(k, t, a, b)}
                    for kind, s, e in sorted(held, key=lambda x: (x[1] - x[2], x[1], x[0])):
                        if not any(s < e2 and s2 < e for _, s2, e2 in base + more):
                            more.append((kind, s, e))
                n = [sum(k == j for k, _, _ in base) for j in range(4)]
                texts_ = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(x)) for x in (base, base + more)]
                rows.append((doc, *n, hashlib.sha256(texts_[0].encode()).hexdigest(), texts_[1]))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [batch.column(0).type] + [pa.int64()] * 4 + [pa.string()] * 2
                names = ["doc", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    out = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("doc", id_col)


def op3_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
