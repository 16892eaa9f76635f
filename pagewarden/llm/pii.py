"""Personal data: fixed patterns, and a semi-Markov conditional random field for other spellings.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern. The field adds spans of the same
kinds that the patterns miss: addresses with "at" or "(at)", phone numbers without a plus sign, numbers with unusual
separators. A segmentation parts a stretch of tokens into segments: single outside tokens, and whole candidate segments of a kind. Its score is
the sum of the candidates' scores, from features of the whole segment and its neighbours, and of transitions between the labels of neighbouring
segments. Its chance is the exponential of that, divided by the sum over all segmentations, which the forward recursion gives.
Weights maximise the log likelihood of labelled examples less a quadratic penalty; the gradient comes from forward and backward sums.

The best segmentation is found by a dynamic programme over places, labels and the number of entities so far. A stretch is parted between tokens that no
candidate crosses; the bound on a part's entities is the number of candidates that fit beside each other in it, so it drops none
(a part with many is searched without that number, for the same maximum in time that grows with its length).

Examples are labelled in the tasks, from whole texts: base matches, respelled, with surroundings; stretches as they are; numbers that are no
match. At most ``max_examples`` of them, the first by a hash, of at most ``example_chars`` characters, are learned from; what is searched has no such bound.

Offsets are code points, ends exclusive. Null text is empty. Repeated rows are reported alike, and an empty table gives
an empty result (with nothing to learn from, the field adds nothing). Very long texts are searched whole, in time that grows with their length.
Of segmentations with equal scores one is taken by the order in which the programme tries them, the same in every run.
Extra columns of ``docs`` pass through; one that is named like a result gives way to it.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import as_text, materialize, place, plain, restored, with_fields

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, str]

# The base patterns. A run of digits is tried from its first digit only, as later starts end alike.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping within a kind, by kind as listed and then by start."""
    found: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# The field. Stretches hold what could be an entity: digits with separators, or an "at" sign or word between words.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
NUMBERS = re.compile(r"[0-9][0-9().\[\]\x20/-]{5,}[0-9]")
AT_WORDS = re.compile(r"(?:[\[({<]\s*(?:at|AT)\s*[\])}>]|\s(?:at|AT)\s)\s*[A-Za-z0-9-]{1,64}(?:\s*[\[({<]\s*(?:dot|DOT)\s*[\])}>]\s*|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{2}")
AROUND = 40
CUES = frozenset("call card cell contact e email fax host ip mail mobile payment phone reach server tel telephone text visa write".split())


LABELS = ["outside", *KINDS]
AT_TOKEN = frozenset(["at", "At", "aT", "AT", "@"])


@dataclass
class Field:
    """Weights of features; ``transitions[a, b]`` is the score of label b after label a."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    max_tokens: int = 16
    counted: int = 8  # parts with more entities at most are searched without counting them


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Merged surroundings of everything that could be an entity."""
    first = end = -1
    for a, b in sorted(m.span() for pattern in (NUMBERS, AT_WORDS) for m in pattern.finditer(text)):
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if end >= 0 and a > end:
            yield first, end
            first = a
        elif end < 0:
            first = a
        end = max(end, b)
    if end >= 0:
        yield first, end


def _possible(segment: str) -> list[str]:
    """The kinds that a segment could have by its make-up alone."""
    kinds = []
    n = sum(c.isdigit() for c in segment)
    if re.search(r"@|\bat\b", segment, re.I):
        if re.search(r"\.|\bdot\b", segment, re.I) and segment[0].isalnum() and segment[-1].isalpha() and not re.search(r"\b(?:at|dot)$", segment, re.I):
            kinds.append("email")
        return kinds
    if any(c.isalpha() for c in segment) or not segment.isascii() or not segment[-1].isdigit() or segment[0] not in "(0123456789":
        return kinds
    parts = re.findall(r"[0-9]+", segment)
    if len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts) and segment[0] != "(":
        kinds.append("ip")
    if 13 <= n <= 19 and len(parts) > 1 and luhn(_digits(segment)):
        kinds.append("card")
    if 9 <= n <= 15 and 2 <= len(parts) <= 6 and not re.search(r"[,;:]", segment):
        kinds.append("phone")
    return kinds


def _features(text: str, a: int, b: int, kind: str, left: str, right: str) -> list[str]:
    segment = text[a:b]
    shape = re.sub(r"[0-9]+", lambda m: f"{len(m[0])}" if len(m[0]) < 6 else "n", re.sub(r"[A-Za-z]+", lambda m: m[0].lower() if m[0].lower() in ("at", "dot") else "w", segment))
    marks = "".join(sorted({c for c in segment if not c.isalnum()}))
    before, after = text[a - 1 : a], text[b : b + 1]
    names = [f"shape={shape}", f"marks={marks}", f"digits={sum(c.isdigit() for c in segment)}", f"cue={left in CUES}", f"parts={len(re.findall(r'[0-9]+', segment))}"]
    names += [f"edge={before.isalnum() or before in ('-', '.', '/', '+')}{after.isalnum() or after in ('-', '/')}", f"right={right.isdigit()}", f"left={left.isdigit()}", "bias"]
    if kind == "email":
        local = len(re.findall(r"[A-Za-z0-9]+", re.split(r"(?i)@|\bat\b", segment)[0]))
        loose = len(re.findall(r"(?i)\b(?!at\b|dot\b)\w+\s+(?!at\b|dot\b)\w", segment))  # blanks between ordinary words
        names += [f"loose={min(3, loose)}", f"words={min(9, len(re.findall(r'[A-Za-z0-9]+', segment)))}", f"local={min(4, local)}", f"goes_on={right.lower() == 'dot'}", f"top={re.split(r'[^A-Za-z]+', segment)[-1].lower()}"]
    return [f"{kind}|{x}" for x in names]


#: No kind has more digits.
MOST_DIGITS = 19


def _candidates(text: str, covered: bytearray, model: Field) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    """Tokens of a stretch, and its candidate segments as (first token, end token, kind, features). ``covered`` has a 1 for each character that is taken."""
    tokens = [m.span() for m in TOKEN.finditer(text)]
    values = [text[a:b] for a, b in tokens]
    free = [covered.find(1, a, b) < 0 for a, b in tokens]
    digits = [sum(c.isdigit() for c in v) for v in values]
    letters = [any(c.isalpha() for c in v) for v in values]
    n = len(tokens)
    next_at = [n] * (n + 1)  # the next token that is an "at"
    for i in range(n - 1, -1, -1):
        next_at[i] = i if values[i] in AT_TOKEN else next_at[i + 1]
    out = []
    for i in range(n):
        a = tokens[i][0]
        if not free[i] or not (text[a].isalnum() or text[a] == "("):
            continue
        address = next_at[i] < i + model.max_tokens  # else only numbers are possible
        total = 0
        for j in range(i, min(n, i + model.max_tokens)):
            total += digits[j]
            if not free[j] or j > i and tokens[j][0] - tokens[j - 1][1] > 3 or not address and (letters[j] or total > MOST_DIGITS):
                break
            if total < 4 and not next_at[i] <= j or not values[j][-1].isalnum():
                continue
            for kind in _possible(text[a : tokens[j][1]]):
                left = values[i - 1].lower() if i else ""
                right = values[j + 1] if j + 1 < n else ""
                out.append((i, j + 1, kind, _features(text, a, tokens[j][1], kind, left, right)))
    return tokens, out


def best_segments(n_tokens: int, candidates: list, score: Callable[[tuple], float], max_entities: int | None, transitions: np.ndarray | None = None) -> list[int]:
    """Indices of the non-overlapping candidates of the best segmentation; at most ``max_entities`` of them, if that is given.

    best[k][t][y]: the first t tokens with k entities, the last segment of label y; without a bound there is one k for all numbers.
    """
    by_end: dict[int, list[int]] = defaultdict(list)
    for c, (_, end, *_) in enumerate(candidates):
        by_end[end].append(c)
    steps = [[0.0] * len(LABELS)] * len(LABELS) if transitions is None else transitions.tolist()
    scores, none, every = [score(c) for c in candidates], float("-inf"), range(len(LABELS))
    kinds = [LABELS.index(kind) for _, _, kind, *_ in candidates]
    most = 0 if max_entities is None else max_entities
    best = [[[none] * len(LABELS) for _ in range(n_tokens + 1)] for _ in range(most + 1)]
    back: dict[tuple[int, int, int], tuple[int, int]] = {}  # (k, t, label): the candidate, or -1, and the label before
    best[0][0][0] = 0.0
    for k in range(most + 1):
        for t in range(1, n_tokens + 1):
            before, now = best[k][t - 1], best[k][t]
            y = max(every, key=lambda y: before[y] + steps[y][0])
            now[0], back[k, t, 0] = before[y] + steps[y][0], (-1, y)
            if max_entities is not None and k == 0:
                continue
            for c in by_end.get(t, ()):
                own, earlier = kinds[c], best[k if max_entities is None else k - 1][candidates[c][0]]
                y = max(every, key=lambda y: earlier[y] + steps[y][own])
                if (value := earlier[y] + steps[y][own] + scores[c]) > now[own]:
                    now[own], back[k, t, own] = value, (c, y)
    k, y = max(((k, y) for k in range(most + 1) for y in every), key=lambda x: best[x[0]][n_tokens][x[1]])
    chosen, t = [], n_tokens
    while t > 0:
        c, before_y = back[k, t, y]
        if c < 0:
            t, y = t - 1, before_y
        else:
            chosen.append(c)
            t, y, k = candidates[c][0], before_y, k if max_entities is None else k - 1
    return chosen[::-1]


def windows(candidates: list) -> Iterator[list]:
    """Candidates in the order of their first tokens, parted between tokens that no candidate crosses: each part is searched alone."""
    part, reach = [], 0
    for c in sorted(candidates, key=lambda c: c[0]):
        if part and c[0] >= reach:
            yield part
            part = []
        part.append(c)
        reach = max(reach, c[1])
    if part:
        yield part


def most_segments(candidates: list) -> int:
    """How many candidates fit beside each other at most."""
    n = reach = 0
    for i, end, *_ in sorted(candidates, key=lambda c: c[1]):
        if i >= reach:
            n, reach = n + 1, end
    return n


def decode(text: str, taken: list[Span], model: Field) -> list[Span]:
    """Spans that the field adds to a text in which ``taken`` are found already."""
    if not model.weights:
        return []
    get, out, covered = model.weights.get, [], None
    for first, end in stretches(text):
        if covered is None:
            covered = bytearray(len(text))
            for a, b, _ in taken:
                covered[a:b] = b"\x01" * (b - a)
        tokens, candidates = _candidates(text[first:end], covered[first:end], model)
        for part in windows(candidates):
            start = min(c[0] for c in part)
            moved = [(i - start, j - start, kind, names) for i, j, kind, names in part]
            most = most_segments(part)
            for c in best_segments(max(c[1] for c in moved), moved, lambda c: sum(get(f, 0.0) for f in c[3]), most if most <= model.counted else None, model.transitions):
                i, j, kind, _ = part[c]
                out.append((first + tokens[i][0], first + tokens[j - 1][1], kind))
    return out


def _respell(value: str, kind: str, rng: random.Random) -> str | None:
    """Another spelling of a base match, that the patterns miss."""
    if kind == "email":
        at, dot = rng.choice([(" at ", "."), (" at ", " dot "), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", ".")])
        name, _, host = value.partition("@")
        head, _, top = host.rpartition(".")
        return re.sub(r"[^A-Za-z0-9]", "", name)[-12:] + at + rng.choice([head, head.replace(".", dot)]) + dot + top
    digits = _digits(value)
    if kind == "phone" and len(digits) >= 10:
        d = digits[-10:]
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "{} {}-{}"]).format(d[:3], d[3:6], d[6:])
    if kind == "card":
        return rng.choice([".", " - ", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return value.replace(".", rng.choice([" . ", "[.]", "(.)"]))
    return None


Example = tuple[str, list[tuple[int, int]], list[Span]]


def examples(text: str, seed: int = 7, longest: int = 1000) -> Iterator[Example]:
    """(stretch, places taken, spans to find) of a whole text: respelled matches, matches as they are, and numbers that are no match. Stretches of over ``longest`` characters are no examples."""
    base = base_spans(text)
    for a, b, kind in base:
        rng = random.Random(zlib.crc32(text[max(0, a - AROUND) : b].encode(), seed))
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        if (new := _respell(text[a:b], kind, rng)) and not base_spans(new):
            if DIGIT.search(before + after) or "@" in before + after:
                before, after = re.sub(r"[0-9@+]", "", before), re.sub(r"[0-9@+]", "", after)
            cue = rng.choice(["", "", "", "call ", "mail ", "tel ", "card ", "ip "])
            yield before + cue + new + after, [], [(len(before + cue), len(before + cue + new), kind)]
            if kind in ("phone", "card", "ip"):  # like numbers that are not personal data
                d = _digits(text[a:b])
                for other in (f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[:2]}:{d[2:4]}", f"{d} {d[:3]}", f"{d[:3]}, {d[3:6]}, {d[6:9]}, {d[:4]}", f"{d[:2]}/{d[2:4]}/{d[4:8]} - {d[:2]}/{d[2:4]}/{d[4:8]}"):
                    if not base_spans(other):
                        yield before + other + after, [], []
    for first, end in stretches(text):
        if end - first <= longest:
            yield text[first:end], [(max(a, first) - first, min(b, end) - first) for a, b, _ in base if a < end and first < b], []


def likelihood(n: int, ends: list[tuple[int, int, int]], scores: np.ndarray, wanted: set[int], transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log chance of a segmentation of n tokens, and its gradients by the candidates' scores and by the transitions.

    ``ends`` are the candidates as (first token, end token, label); ``wanted`` are those of the segmentation, all other tokens being outside.
    Sums are of exponentials as they are, in extended precision, whose range an example's score doesn't leave.
    """
    by_end, by_start = defaultdict(list), defaultdict(list)
    for c, (i, j, _) in enumerate(ends):
        by_end[j].append(c)
        by_start[i].append(c)
    step, gain = np.exp(transitions.astype(np.longdouble)), np.exp(scores.astype(np.longdouble))
    alpha, beta = np.zeros((n + 1, len(LABELS)), dtype=np.longdouble), np.zeros((n + 1, len(LABELS)), dtype=np.longdouble)
    reach = np.empty_like(alpha)  # reach[t][y]: all ways to t, with the step to a segment of label y
    alpha[0, 0] = 1.0
    for t in range(n + 1):
        if t:
            alpha[t, 0] = reach[t - 1, 0]
            for c in by_end.get(t, ()):
                i, _, y = ends[c]
                alpha[t, y] += reach[i, y] * gain[c]
        reach[t] = alpha[t] @ step
    total = alpha[n].sum()
    beta[n] = 1.0
    after = np.zeros_like(alpha)  # after[t][y]: all ways on from t whose next segment has label y, without the step to it
    for t in range(n - 1, -1, -1):
        after[t, 0] = beta[t + 1, 0]
        for c in by_start.get(t, ()):
            _, j, y = ends[c]
            after[t, y] += gain[c] * beta[j, y]
        beta[t] = step @ after[t]
    expected = ((alpha[:n].T @ after[:n]) * step / total).astype(float)
    first, end, own = np.array(ends).T
    shares = (reach[first, own] * gain * beta[end, own] / total).astype(float)
    seen, value, t, last = np.zeros_like(transitions), 0.0, 0, 0
    starts = {ends[c][0]: c for c in wanted}
    while t < n:
        c = starts.get(t)
        y, t = (0, t + 1) if c is None else (ends[c][2], ends[c][1])
        value += transitions[last, y] + (0.0 if c is None else scores[c])
        seen[last, y] += 1
        last = y
    observed = np.zeros(len(ends))
    observed[list(wanted)] = 1.0
    return value - float(np.log(total)), observed - shares, seen - expected


def train(labelled: list[Example], passes: int = 3, rate: float = 0.3, penalty: float = 1e-3, seed: int = 7) -> Field:
    """Weights that maximise the log likelihood less ``penalty`` / 2 times their squares, by steps scaled with past gradients."""
    model, numbers, prepared = Field(), {}, []
    for text, taken, spans in labelled:
        covered = bytearray(len(text))
        for a, b in taken:
            covered[a:b] = b"\x01" * (b - a)
        tokens, candidates = _candidates(text, covered, model)
        found = {(tokens[i][0], tokens[j - 1][1], kind): c for c, (i, j, kind, _) in enumerate(candidates)}
        if not candidates or any(x not in found for x in spans):
            continue
        features = [[numbers.setdefault(f, len(numbers)) for f in c[3]] for c in candidates]
        starts = np.cumsum([0, *map(len, features)])[:-1]
        ends = [(i, j, LABELS.index(kind)) for i, j, kind, _ in candidates]
        prepared.append((len(tokens), ends, np.array([f for x in features for f in x]), starts, {found[x] for x in spans}))
    if not prepared:
        return model
    weights, past = np.zeros(len(numbers)), np.full(len(numbers), 1e-8)
    steps, step_past = np.zeros_like(model.transitions), np.full_like(model.transitions, 1e-8)
    rng = random.Random(seed)
    for _ in range(passes):
        rng.shuffle(prepared)
        for n, ends, flat, starts, wanted in prepared:
            _, by_score, by_step = likelihood(n, ends, np.add.reduceat(weights[flat], starts), wanted, steps)
            gradient = np.repeat(by_score, np.diff(starts, append=len(flat)))
            places, back = np.unique(flat, return_inverse=True)
            gradient = np.bincount(back, weights=gradient) - penalty * weights[places]
            past[places] += gradient**2
            weights[places] += rate * gradient / np.sqrt(past[places])
            step_past += by_step**2
            steps += rate * by_step / np.sqrt(step_past)
    model.weights, model.transitions = dict(zip(numbers, weights.tolist(), strict=True)), steps
    return model


def label(docs: DataFrame, example_chars: int = 1000) -> DataFrame:
    """h, text, taken, wanted: the examples of all documents that may hold personal data, with a hash of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = [x for text in as_text(batch.column("text")) for x in examples(text, longest=example_chars)]
            spans = [[{"start": a, "stop": b, "kind": k} for a, b, k in x[2]] for x in rows]
            taken = [[{"start": a, "stop": b, "kind": ""} for a, b in x[1]] for x in rows]
            hashes = np.array([xxhash.xxh64_intdigest(x[0]) for x in rows], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([x[0] for x in rows], pa.string()), pa.array(taken, SPANS), pa.array(spans, SPANS)], names=["h", "text", "taken", "wanted"])

    likely = docs.select("text").filter(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]|[0-9]{4}[ -]?[0-9]{4}"))
    return likely.mapInArrow(work, f"h bigint, text string, taken {SPAN_TYPE}, wanted {SPAN_TYPE}")


def fit(docs: DataFrame, max_examples: int = 2500, example_chars: int = 1000) -> Field:
    """Learn from at most ``max_examples`` labelled examples (of at most ``example_chars`` characters) of the documents, each once, the first by their hash."""
    labelled = materialize(label(docs, example_chars), "examples")
    # Hashes alone are ordered; examples reach the driver only for those that are taken.
    last = labelled.select("h").distinct().orderBy("h").limit(max_examples).agg(F.max("h")).first()[0]
    rows = [] if last is None else labelled.filter(F.col("h") <= last).dropDuplicates(["h"]).limit(max_examples).collect()
    return train([(r.text, [(s.start, s.stop) for s in r.taken], [(s.start, s.stop, s.kind) for s in r.wanted]) for r in sorted(rows, key=lambda r: r.h)])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
SPAN_TYPE = "array<struct<start:bigint,stop:bigint,kind:string>>"
RESULTS = ("base", "added")


def scan(docs: DataFrame, model: Field | None = None, max_examples: int = 2500, example_chars: int = 1000) -> DataFrame:
    """Columns of ``docs`` and base, added: arrays of (start, stop, kind). Without a model one is fitted to ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, max_examples, example_chars) if model is None else model)
    at = place(docs, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for text in as_text(batch.column(at)):
                base.append(base_spans(text))
                added.append(decode(text, base[-1], shared.value))
            columns = [pa.array([[{"start": a, "stop": b, "kind": k} for a, b, k in x] for x in y], SPANS) for y in (base, added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *RESULTS])

    return restored(plain(docs).mapInArrow(work, with_fields(docs, f"base {SPAN_TYPE}, added {SPAN_TYPE}")), docs, RESULTS)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans."""
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    counts = [F.size(F.filter("base", _is(kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(ranked)).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == F.lit(kind)
