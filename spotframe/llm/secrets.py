"""Secret scans: rules, and a character convolutional network over every candidate with its context.

Three rules give findings that always stay. Every other run of ``LEAST`` or more characters of keys, addresses and words is a
candidate, whatever it is made of; so are the parts of such runs outside of the rules' findings, and shorter values that follow a name of a
secret. A network with one convolution over the characters before, in and after a candidate gives a calibrated probability, and
candidates above a threshold become findings of kind ``cnn``. The network gives the rules' findings a score too.

It is fitted on all documents. Tasks read whole texts: the rules' findings are the labelled findings, the other candidates, found as in a
scan, the negatives; as rules see few forms, about ``MADE`` secrets and ``MADE`` harmless tokens of other forms are made and set into places of
documents from all over the table. Two of three documents train, by a hash of the text. Different examples are dealt into shards by a hash;
a first chunk of one starts the weights, then every shard goes over all of its examples and the shards' weights are averaged, in ``ROUNDS`` rounds.
Every sixth document sets calibration (Platt, with candidates in the balance of real text) and threshold: the largest step of 1 / ``STEPS`` of the
network's output that keeps a recall of ``RECALL`` of the rules' findings, of made ones of their forms (a sixth of ``MADE``) and of the made
secrets, each for itself. Every other sixth sets nothing: ``Network.report`` has what was measured there. All of these are counted by
Spark over all documents, equal ones as often as they stand there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.common import discard, sliced, written

KINDS = ("assign", "access", "hex", "cnn")
LEAST, BEFORE, INSIDE, AFTER = 12, 28, 44, 12
MADE, RECALL = 2700, 0.95
MADE_WEIGHT = 0.05  # of a made example, for calibration
SPARE, SPARE_REAL = 0.995, 0.9999  # shares of made harmless tokens and of harmless candidates below `certain`
SHARDS, CHUNK, ROUNDS = 64, 20_000, (0.002, 0.0007)  # most shards; examples that make a further shard; rates of the rounds
STEPS, FAR = 256, 40  # outputs are counted in steps, from -FAR to FAR
DEAL = (1, 0, 0, 2, 0, 0)  # documents for training (0), thresholds (1) and the report (2)
HARMLESS, RULE, MADE_HARMLESS, MADE_SECRET, MADE_RULE = range(5)  # groups of examples
EMBED, WIDTH, FILTERS, HIDDEN = 8, 5, 24, 24

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are taken whole, so shorter ones never match a part
RUN = re.compile(r"[A-Za-z0-9+/_.=$!%&*#~^?@:-]{12,}")
KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*[:=]+(?![:=/])")  # a name before a value in the same run
VALUE = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth|credential)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_.=$!%&*#~^?@:-]{6,})", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, stop) of the rules' findings, in code points, sorted."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs, and short values after a name of a secret, without what the rules' findings cover; sorted, none touches another."""
    spans = []
    for m in RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".:?!":
            b -= 1
        name = KEY.match(text, a, b)
        if name and b - name.end() >= LEAST // 2:
            a = name.end()
        spans.append((a, b, LEAST if not name else LEAST // 2))
    low = text.lower() if len(spans) or "=" in text or ":" in text else ""
    if low and any(n in low for n in ("pass", "pwd", "secret", "token", "api", "auth", "credential")):
        spans += [(*m.span(1), LEAST // 2) for m in VALUE.finditer(text)]
        spans.sort()
    out, k, reach = [], 0, 0
    for a, b, least in spans:
        a = max(a, reach)
        while k < len(base) and base[k][2] <= a:
            k += 1
        j = k
        while j < len(base) and base[j][0] < b:
            if base[j][0] - a >= least:
                out.append((a, 3, base[j][0]))
            a, j = max(a, base[j][2]), j + 1
        if b - a >= least:
            out.append((a, 3, b))
        reach = max(reach, b)
    return out


PAD = "\udfff"  # stands in no text
CODES = np.array([1] * 32 + [c - 30 for c in range(32, 127)] + [97], dtype=np.uint8)


def windows(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Character numbers around each span: BEFORE, the first and last of INSIDE, AFTER; 0 where there are none, 97 for others."""
    parts = []
    for a, _, b in spans:
        inside = text[a:b] if b - a <= INSIDE else text[a : a + INSIDE // 2] + text[b - INSIDE // 2 : b]
        parts += [text[max(0, a - BEFORE) : a].rjust(BEFORE, PAD), inside.ljust(INSIDE, PAD), text[b : b + AFTER].ljust(AFTER, PAD)]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes == ord(PAD), 0, CODES[np.minimum(codes, 127)]).astype(np.uint8).reshape(len(spans), BEFORE + INSIDE + AFTER)


@dataclass
class Network:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    certain: float = 0.5  # above the scores of SPARE_REAL of the harmless candidates and of SPARE of the made harmless tokens
    report: dict[str, float] | None = None  # of the documents that set nothing: recall of rules' and made secrets, share of real and made harmless candidates taken

    @staticmethod
    def new(seed: int) -> Network:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.normal(size=s) * np.sqrt(2 / s[0])).astype(np.float32)
        return Network({"embed": r.normal(size=(98, EMBED)).astype(np.float32) * 0.5, "conv": n(WIDTH * EMBED, FILTERS), "conv_b": np.zeros(FILTERS, np.float32), "dense": n(3 * FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN, 1), "out_b": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        emb = np.pad(w["embed"][x], ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1], -1)
        conv = np.maximum(cols @ w["conv"] + w["conv_b"], 0)
        cuts = (0, BEFORE, BEFORE + INSIDE, x.shape[1])
        best = [conv[:, a:b].argmax(axis=1) + a for a, b in zip(cuts, cuts[1:], strict=False)]
        pooled = np.concatenate([np.take_along_axis(conv, k[:, None], axis=1)[:, 0] for k in best], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return (hidden @ w["out"] + w["out_b"])[:, 0], (cols, conv, best, pooled, hidden)

    def logits(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[k : k + batch])[0] for k in range(0, len(x), batch)]) if len(x) else np.zeros(0)

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z, (cols, conv, best, pooled, hidden) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / len(x)).astype(np.float32)[:, None]
        g = {"out": hidden.T @ dz, "out_b": dz.sum(axis=0)}
        dh = (dz @ w["out"].T) * (hidden > 0)
        g |= {"dense": pooled.T @ dh, "dense_b": dh.sum(axis=0)}
        dp = dh @ w["dense"].T
        dconv = np.zeros_like(conv)
        for k, at in enumerate(best):
            part = dp[:, k * FILTERS : (k + 1) * FILTERS]
            np.put_along_axis(dconv, at[:, None], np.take_along_axis(dconv, at[:, None], axis=1) + part[:, None], axis=1)
        dconv *= conv > 0
        flat = dconv.reshape(-1, FILTERS)
        g |= {"conv": cols.reshape(len(flat), -1).T @ flat, "conv_b": flat.sum(axis=0)}
        dcols = (dconv @ w["conv"].T).reshape(len(x), x.shape[1], WIDTH, EMBED)
        demb = np.zeros((len(x), x.shape[1] + WIDTH - 1, EMBED), dtype=np.float32)
        for k in range(WIDTH):
            demb[:, k : k + x.shape[1]] += dcols[:, :, k]
        one_hot = np.eye(len(w["embed"]), dtype=np.float32)[x.reshape(-1)]
        g["embed"] = one_hot.T @ demb[:, WIDTH // 2 : WIDTH // 2 + x.shape[1]].reshape(-1, EMBED)
        return g


def _made(rng: np.random.Generator, secret: bool) -> tuple[str, str]:
    """What stands before a token, and the token."""
    pick = lambda s: s[int(rng.integers(len(s)))]
    take = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if secret:
        n = int(rng.integers(16, 64))
        word = lambda: take(low, int(rng.integers(3, 8)))
        token = pick([
            take(low + up + num, n), take(low + up + num + "+/", n) + pick(["", "=", "=="]), take(low + num, n), pick(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"]) + take(low + up + num, n), take("0123456789ABCDEF", n),
            "eyJ" + take(low + up + num, 17) + "." + take(low + up + num + "_-", n) + "." + take(low + up + num + "_-", 32), take(low + up, int(rng.integers(16, 40))), take(low + up + "/", int(rng.integers(24, 44))), take(low + up + num + "$!%&*#~^?@", int(rng.integers(12, 30))),
        ])
        lead = pick(["", "", "", "key: ", "auth=", "Bearer ", "credential = \"", "pwd=", "client_secret: ", "private_key = '", "export KEY="])
        if rng.random() < 0.25:  # passwords, app passwords and number keys are told by what stands before them
            token = pick([f"{word()}{pick('$!%&*#@')}{take(num, 2)}{word()}{pick('$!%&*#@')}{take(num, 1)}", f"{word().title()}{take(num, 1)}{word()}{pick('&$#@!')}{take(num, 1)}{word()}{word().title()}!", take(low, 16)])
            lead = pick(["password: ", "pwd=", "pwd: ", "passwd: ", "secret key: ", "api key: ", "credential = \"", "auth="])
        return lead, token
    return pick(["", "", "", "", "http://x.example/", "id: ", "see ", "page=", "version ", "name: ", "file="]), _harmless(rng)


def _ruled(rng: np.random.Generator) -> tuple[str, str]:
    """Forms of the rules that tables hold by the dozen only: long numbers and digests are findings wherever they stand, shorter numbers are harmless."""
    n = 16 if rng.random() < 0.7 else int(rng.integers(17, 41))
    digits = "0123456789" if rng.random() < 0.8 else "0123456789abcdef"
    return ("", "", "", "no. ", "id: ")[int(rng.integers(5))], "".join(digits[i] for i in rng.integers(0, len(digits), n))


def _harmless(rng: np.random.Generator) -> str:
    """Tokens as they stand in prose, code, logs and addresses: words that can be said or not, dates, numbers, names with dots, dashes and capitals."""
    pick = lambda s: s[int(rng.integers(len(s)))]
    take = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    said = rng.random() < 0.7

    def word() -> str:
        if not said:
            return take(low, int(rng.integers(2, 9)))
        return "".join(pick(["b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "ch", "pr", "th", ""]) + pick(["a", "e", "i", "o", "u", "ei", "ou", "ie", "y"]) + pick(["", "", "n", "r", "s", "t", "l", "m", "ng", "ck", "ft"]) for _ in range(int(rng.integers(1, 4))))

    many = lambda by, lo, hi, of=word: by.join(of() for _ in range(int(rng.integers(lo, hi))))
    title = lambda: word().title()
    two = lambda below: f"{int(rng.integers(below)):02d}"
    day, clock = f"{take('12', 1)}{take(num, 3)}-{two(13)}-{two(32)}", f"{two(24)}:{two(60)}:{two(60)}"
    part = lambda: str(int(rng.integers(256)))
    if rng.random() < 0.5:
        return pick([
            f"{day}T{clock}{pick(['Z', '', '+02:00', '-0500', '.' + take(num, 3) + 'Z', '.' + take(num, 6)])}", f"{clock}.{take(num, 6)}", f"{pick(['Mon', 'Sat', 'Thu'])},{two(32)}{title()[:3]}20{two(99)}-{clock}", f"{two(32)}.{two(13)}.20{two(99)}-{clock}",
            many("", 4, 10) + "ung", many("", 3, 8).title(), many(".", 3, 7), f"{many('.', 2, 6)}.{many('', 1, 5, title)}", f"{word()}{many('', 2, 6, title)}", many("", 3, 7, title), many("_", 3, 6).upper(), f"{many('_', 2, 5)}_{take(num, 2)}",
            f"arn:aws:{word()[:4]}:::{many('-', 2, 4)}", f"arn:aws:{word()[:4]}:{word()[:2]}-{word()}-1:{take(num, 12)}:{word()}/{title()}", "-".join(take("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), f"{'.'.join(part() for _ in range(4))}:{take(num, 4)}", f"{many('.', 2, 4)}:{take(num, 4)}",
            f"{pick(['~', '.', '$HOME', '/usr', '/var', 'C:'])}/{many('/', 2, 6)}.{word()[:4]}", f"https://{many('.', 2, 4)}/{many('/', 1, 4)}/{title()}.md#{many('-', 1, 4)}", f"https://{word()}.com/?{word()}={take(num, 3)}&{word()}={word()}", f"{many('-', 1, 4)}-{take(num, 1)}.{take(num, 2)}.{take(num, 1)}{pick(['', '-SNAPSHOT', '.tar.gz', '.jar'])}",
            f"+{take(num, 2)}-{take(num, 3)}-{take(num, 7)}", f"97{take(num, 1)}-{take(num, 1)}-{take(num, 2)}-{take(num, 6)}-{take(num, 1)}", f"{many('-', 1, 3)}={many('-', 2, 5)}", f"{many('::', 2, 5)}", f"{title()}::{many('_', 2, 4)}", f"@{word()}/{many('-', 2, 4)}@{take(num, 1)}.{take(num, 1)}.{take(num, 1)}", many("-", 3, 7), many("+", 3, 5), f"{word()}.{many('_', 2, 4)}=={take(num, 1)}.{take(num, 2)}",
        ])
    return pick([
        f"{word()}-{word()}-{int(rng.integers(1, 2100))}", f"{word()}_{word()}_{int(rng.integers(10))}", f"{take(up, 2)}-{take(num, 10)}", f"{word()}/{word()}/{take(num, 4)}/{word()}", f"{word()}{word()}{word()}{word()}", f"{word()}-{word()}-{word()}-{word()}",
        f"{take(num, 4)}-{take(num, 2)}-{take(num, 2)}T{take(num, 2)}", f"{word()}{word()}{take(num, 2)}", f"{word().title()}{word().title()}{take(num, 1)}", f"{word()}+{take(num, 10)}", f"v{take(num, 1)}-{word()}-{word()}", f"{word()}={take(num, 8)}",
        f"http://{word()}.example/{word()}/{word()}.html", f"https://www.{word()}.org/{word()}?page={take(num, 2)}", f"{word()}.{word()}@{word()}.com", take(num, int(rng.integers(12, 16))), pick("-=*#_.~") * int(rng.integers(12, 40)), f"{word()}.{word()}.{word()}{word()}()".rstrip("()"), f"{word().upper()}{word().upper()}{word().upper()}", f"/{word()}/{word()}/{word()}.{word()[:3]}",
    ])


@dataclass
class Examples:
    """Windows with labels of one part of the documents. Real ones stand in their texts, made ones are set into places of them."""

    real: np.ndarray
    labels: np.ndarray
    made: np.ndarray
    made_labels: np.ndarray
    ruled: np.ndarray  # made ones of the rules' forms

    def groups(self) -> dict[int, np.ndarray]:
        return {HARMLESS: self.real[self.labels == 0], RULE: self.real[self.labels == 1], MADE_HARMLESS: self.made[self.made_labels == 0], MADE_SECRET: self.made[self.made_labels == 1], MADE_RULE: self.ruled}


def found(text: str, most: int = 20_000):
    """(groups, windows) of all that stands in a text, some thousands at a time."""
    base = base_spans(text)
    spans = base + more_candidates(text, base)
    for k in range(0, len(spans), most):
        some = spans[k : k + most]
        yield np.where([x[1] == 3 for x in some], HARMLESS, RULE), windows(text, some)


def set_in(text: str, n: int, rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
    """(group, window) of ``n`` made tokens in places of a text, and of made ones of the rules' forms, one for twelve."""
    out = []
    for k in range(n):
        at = int(rng.integers(len(text) + 1))
        blank = max(text.rfind(c, max(0, at - 200), at) for c in " \t\n\r")
        at = max(blank, 0)
        before, after = text[max(0, at - 2 * BEFORE) : at], text[at : at + 2 * AFTER]
        secret = rng.random() < 0.5
        tokens = [(MADE_SECRET if secret else MADE_HARMLESS, _made(rng, secret))] + ([(MADE_RULE, _ruled(rng))] if rng.random() < 1 / 12 else [])
        for group, (lead, token) in tokens:
            head = f"{before} {lead}"
            out.append((group, windows(f"{head}{token} {after}", [(len(head), 3, len(head) + len(token))])))
    return out


def made_share(documents: int) -> list[float]:
    """Made tokens of a document of each part, so that parts have 2 MADE, MADE and MADE of them."""
    return [(2 if not part else 1) * MADE / max(1.0, documents * DEAL.count(part) / len(DEAL)) for part in range(3)]


EMPTY = np.zeros((0, BEFORE + INSIDE + AFTER), dtype=np.uint8)


def examples(texts, seed: int = 11, deal: tuple[int, ...] = DEAL) -> list[Examples]:
    """Of the documents for training, for thresholds and for the report, dealt in turn by ``deal``."""
    rng = np.random.default_rng(seed)
    texts = list(texts)
    share = made_share(len(texts))
    parts = [{g: [EMPTY] for g in range(5)} for _ in range(3)]
    for n, t in enumerate(texts):
        own = parts[deal[n % len(deal)]]
        for groups, x in found(t):
            for g in (HARMLESS, RULE):
                own[g].append(x[groups == g])
        for g, x in set_in(t, int(share[deal[n % len(deal)]] + rng.random()), rng):
            own[g].append(x)
    out = []
    for part in parts:
        w = {g: np.concatenate(x) for g, x in part.items()}
        label = lambda no, yes: np.repeat(np.array([0, 1], dtype=np.float32), [len(no), len(yes)])
        out.append(Examples(np.concatenate([w[HARMLESS], w[RULE]]), label(w[HARMLESS], w[RULE]), np.concatenate([w[MADE_HARMLESS], w[MADE_SECRET]]), label(w[MADE_HARMLESS], w[MADE_SECRET]), w[MADE_RULE]))
    return out


def teach(net: Network, groups: dict[int, np.ndarray], rates, seed: int) -> Network:
    """A pass of Adam over windows of all groups for each of the rates; the rules' findings are few, so they count more."""
    x = np.concatenate([groups[HARMLESS], np.repeat(groups[RULE], 5, axis=0), *(groups[g] for g in (MADE_HARMLESS, MADE_SECRET, MADE_RULE))])
    harmless = [len(groups[HARMLESS]), 5 * len(groups[RULE]), len(groups[MADE_HARMLESS])]
    y = np.ones(len(x), dtype=np.float32)
    y[: harmless[0]] = 0
    y[sum(harmless[:2]) : sum(harmless)] = 0
    rng = np.random.default_rng(seed)
    used = rng.permutation(len(x))
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(a) for k, a in net.weights.items()}
    step = 0
    for rate in rates:
        for k in range(0, len(used), 64):
            at = rng.permutation(used)[:64] if k + 64 > len(used) else used[k : k + 64]
            step += 1
            for name, g in net.gradients(x[at], y[at]).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                net.weights[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        rng.shuffle(used)
    return net


def first_rates(n: int) -> list[float]:
    """Rates of the passes over the first ``n`` examples: more passes over few."""
    return [0.004] * (min(7, max(3, math.ceil(90_000 / max(n, 1)))) - 2) + [0.001] * 2


def steps(z: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(z, -FAR, FAR - 1 / STEPS) * STEPS).astype(np.int64) + FAR * STEPS


def settle(net: Network, counts: dict[tuple[int, int], np.ndarray]) -> Network:
    """Calibration, thresholds and report, of how many examples of each (part, group) have an output in each step."""
    none = np.zeros(2 * FAR * STEPS)
    of = lambda part, group: counts.get((part, group), none)
    z = (np.arange(len(none)) + 0.5) / STEPS - FAR
    real, made = of(1, HARMLESS) + of(1, RULE), of(1, MADE_HARMLESS) + of(1, MADE_SECRET)
    weight, positive = real + MADE_WEIGHT * made, of(1, RULE) + MADE_WEIGHT * of(1, MADE_SECRET)
    weight, positive = weight / weight.sum(), positive / weight.sum()
    slope, shift = 1.0, 0.0
    for _ in range(300):  # Platt scaling, by gradient on standardised scores
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        slope -= 0.5 * float(((weight * p - positive) * z).sum()) / max(1.0, float((weight * z * z).sum()) / 4)
        shift -= 0.5 * float((weight * p - positive).sum())
    net.slope, net.shift = max(slope, 1e-3), shift
    above = lambda c: np.append(c[::-1].cumsum()[::-1], 0)  # from each step on
    keeps = [int(np.flatnonzero(above(c) >= RECALL * c.sum())[-1]) for c in (of(1, RULE), of(1, MADE_SECRET), of(1, MADE_RULE)) if c.sum()]
    spares = [int(np.flatnonzero(above(c) <= (1 - share) * c.sum() + 1e-9)[0]) for c, share in ((of(0, HARMLESS) + of(1, HARMLESS), SPARE_REAL), (of(1, MADE_HARMLESS), SPARE))]
    least = min(keeps)
    certain = max(least, *spares)
    net.threshold, net.certain = (float(net.calibrated(np.float64(k / STEPS - FAR))) for k in (least, certain))
    share = lambda group, k: float(above(of(2, group))[k] / max(of(2, group).sum(), 1))
    net.report = {"rules": int(of(2, RULE).sum()), "harmless": int(of(2, HARMLESS).sum()), "threshold": net.threshold, "certain": net.certain, "recall_ruled": share(MADE_RULE, least)}
    for name, k in (("", least), ("certain_", certain)):
        net.report |= {f"{name}recall_rules": share(RULE, k), f"{name}false_real": share(HARMLESS, k), f"{name}recall_made": share(MADE_SECRET, k), f"{name}false_made": share(MADE_HARMLESS, k)}
    return net


def fit(texts, seed: int = 11) -> Network:
    """A network of any iterable of texts, in this process; ``train`` does the same for a table."""
    parts = [x.groups() for x in examples(texts, seed)]
    net = teach(Network.new(seed), parts[0], first_rates(sum(map(len, parts[0].values()))), seed)
    return settle(net, {(k, g): np.bincount(steps(net.logits(x)), minlength=2 * FAR * STEPS) for k, part in enumerate(parts) for g, x in part.items()})


def gathered(docs: DataFrame) -> DataFrame:
    """(part, kind, x, n): the different windows of all documents by part and group, and how often they stand there."""
    text = F.col("text").cast("string")
    known = docs.filter(F.col("text").isNotNull()).select(text.alias("text"), F.xxhash64(text).alias("by"), F.xxhash64(text, "doc_id").alias("mark"))
    n = known.count()
    if n < 600:  # so few that a part may have no places: some for made tokens alone
        more = docs.sparkSession.range(60).select(F.concat(F.lit("of the "), F.col("id").cast("string"), F.lit(" of")).alias("text"))
        known, n = known.unionByName(more.select("text", F.xxhash64("text").alias("by"), F.xxhash64("text", F.lit(0)).alias("mark"))), n + 60
    share = made_share(n)

    def batch(part, kinds, x):
        x = np.ascontiguousarray(x)
        ends = pa.py_buffer(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(part, dtype=np.int32)), pa.array(np.asarray(kinds, dtype=np.int32)), pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(x.tobytes())])], names=["part", "kind", "x"])

    def run(batches):
        for b in sliced(batches):
            parts, kinds, xs, held = [], [], [], 0
            for t, by, mark in zip(b.column("text").to_pylist(), b.column("by").to_pylist(), b.column("mark").to_pylist(), strict=True):
                part = DEAL[by % len(DEAL)]
                rng = np.random.default_rng(mark & ((1 << 63) - 1))
                made = set_in(t, int(share[part] + rng.random()), rng)
                for groups, x in (*found(t), *(([g], x) for g, x in made)):
                    parts.append(np.full(len(x), part))
                    kinds.append(groups)
                    xs.append(x)
                    held += len(x)
                    if held >= 20_000:
                        yield batch(np.concatenate(parts), np.concatenate(kinds), np.concatenate(xs))
                        parts, kinds, xs, held = [], [], [], 0
            if held:
                yield batch(np.concatenate(parts), np.concatenate(kinds), np.concatenate(xs))

    return known.mapInArrow(run, "part int, kind int, x binary").groupBy("part", "kind", "x").agg(F.count("*").alias("n"))


def as_windows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, EMPTY.shape[1])


def taught(rows: DataFrame, net: Network, made: dict[int, np.ndarray], rates) -> list[tuple[int, int, dict[str, np.ndarray]]]:
    """(shard, examples, weights) of passes that each shard makes over its rows (shard, kind, x) from the same weights; a shard's rows stand together, chunks are learned one after the other."""
    shared = rows.sparkSession.sparkContext.broadcast((net.weights, made))

    def run(batches):
        start, made = shared.value
        now, n, own, kinds, xs = None, 0, None, [], []

        def learn():
            nonlocal kinds, xs
            k, x = np.concatenate(kinds), np.concatenate(xs)
            groups = {HARMLESS: x[k == HARMLESS], RULE: x[k == RULE]} | made
            teach(own, groups, rates or first_rates(sum(map(len, groups.values()))), now + 1)
            kinds, xs = [], []

        def done():
            if sum(map(len, xs)):
                learn()
            flat = b"".join(own.weights[k].tobytes() for k in sorted(own.weights))
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "n": pa.array([n], pa.int64()), "w": pa.array([flat], pa.binary())})

        for b in batches:
            shards, kind, x = b.column("shard").to_numpy(zero_copy_only=False), b.column("kind").to_numpy(zero_copy_only=False), as_windows(b.column("x"))
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(x)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if shards[a] != now:
                    if now is not None:
                        yield done()
                    now, n, own = int(shards[a]), 0, Network({k: w.copy() for k, w in start.items()})
                while a < z:
                    to = min(z, a + 2 * CHUNK - sum(map(len, xs)))
                    kinds.append(kind[a:to])
                    xs.append(x[a:to])
                    n, a = n + to - a, to
                    if sum(map(len, xs)) == 2 * CHUNK:
                        learn()
        if now is not None:
            yield done()

    out = []
    for r in sorted(rows.mapInArrow(run, "shard int, n long, w binary").collect(), key=lambda r: r["shard"]):  # sorted here, as a sort by ranges would learn twice
        flat, weights, at = np.frombuffer(bytes(r["w"]), dtype=np.float32), {}, 0
        for k in sorted(net.weights):
            weights[k] = flat[at : at + net.weights[k].size].reshape(net.weights[k].shape).copy()
            at += weights[k].size
        out.append((r["shard"], r["n"], weights))
    return out


def counted(seen: DataFrame, net: Network) -> dict[tuple[int, int], np.ndarray]:
    """How many examples of each (part, group) have an output in each step."""
    shared = seen.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("kind"), pa.array(steps(shared.value.logits(as_windows(b.column("x"))))), b.column("n")], names=["part", "kind", "step", "n"])

    out = {}
    for r in seen.mapInArrow(run, "part int, kind int, step long, n long").groupBy("part", "kind", "step").agg(F.sum("n").alias("n")).toLocalIterator():
        out.setdefault((r["part"], r["kind"]), np.zeros(2 * FAR * STEPS))[r["step"]] = r["n"]
    return out


def train(docs: DataFrame, seed: int = 11) -> Network:
    """Fit on all documents; but for the last digits of sums, the result hangs on the rows alone, not on how they are partitioned."""
    seen, path = written(gathered(docs), "secret-examples")
    rows = None
    try:
        made = {g: EMPTY for g in (MADE_HARMLESS, MADE_SECRET, MADE_RULE)}
        # some thousands, whatever the table
        for g in made:
            own = [bytes(r["x"]) for r in seen.filter((F.col("part") == 0) & (F.col("kind") == g)).select("x").orderBy("x").collect()]
            made[g] = np.frombuffer(b"".join(own), dtype=np.uint8).reshape(-1, EMPTY.shape[1])
        real = seen.filter((F.col("part") == 0) & (F.col("kind") <= RULE))
        n = max(1, min(SHARDS, real.count() // CHUNK))
        rows = real.select(F.pmod(F.xxhash64("x"), F.lit(n)).cast("int").alias("shard"), F.xxhash64("x", F.lit(seed)).alias("mark"), "kind", "x").repartition("shard").sortWithinPartitions("shard", "mark", "x", "kind").persist(StorageLevel.DISK_ONLY)
        net = Network.new(seed)
        first = taught(rows.filter("shard = 0").orderBy("mark", "x", "kind").limit(2 * CHUNK), net, made, None)
        if first:
            net.weights = first[0][2]
        else:  # texts without candidates
            teach(net, {HARMLESS: EMPTY, RULE: EMPTY} | made, first_rates(sum(map(len, made.values()))), seed)
        for rate in ROUNDS if n > 1 else ():
            each = taught(rows, net, made, [rate])
            every = sum(k for _, k, _ in each)
            net.weights = {name: sum(w[name].astype(np.float64) * (k / every) for _, k, w in each).astype(np.float32) for name in net.weights}
        return settle(net, counted(seen, net))
    finally:
        if rows is not None:
            rows.unpersist()
        discard(docs.sparkSession, path)


def findings_of(net: Network, texts: list[str | None], least: float | None = None) -> list[list[tuple[int, int, int, float]]]:
    """(start, number of the kind, stop, score) of each text's findings, by start, then kind; the network's from a score of ``least`` on, or its threshold."""
    least = net.threshold if least is None else least
    spans, wins = [], []
    for t in texts:
        base = base_spans(t or "")
        spans.append(base + more_candidates(t or "", base))
        if spans[-1]:
            wins.append(windows(t, spans[-1]))
    scores = iter(net.probabilities(np.concatenate(wins)).tolist() if wins else [])
    scored = [sorted([(a, k, z, next(scores)) for a, k, z in own]) for own in spans]
    return [[x for x in own if x[1] < 3 or x[3] >= least] for own in scored]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, findings) per row; findings are structs (kind, start, stop, score), by start, then kind.

    Places are code points, stop exclusive. Null text counts as empty. Whole texts are read, of any length; repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in sliced(batches):
            out = [[{"kind": KINDS[k], "start": a, "stop": z, "score": p} for a, k, z, p in own] for own in findings_of(shared.value, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "findings": pa.array(out, kind_type)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, findings array<struct<kind:string,start:int,stop:int,score:double>>")


def redact(docs: DataFrame, net: Network, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark`` (findings that overlap or touch by one) and n_chars, if it is there, of the new text.

    What is replaced is lost, so the network's findings count only if they score higher than all but one of 10,000 harmless candidates and than nearly all made harmless tokens (``certain``).
    Texts without findings, null ones too, stay as they are, and so do their other columns, whatever their names. Whole texts are
    read, of any length; repeated rows are changed alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            changed = {}
            for r, own in enumerate(findings_of(shared.value, texts, shared.value.certain)):
                if own:
                    out, reach = [], 0
                    for a, _, z, _ in own:
                        if a > reach or not out:
                            out += [texts[r][reach:a], mark]
                        reach = max(reach, z)
                    changed[r] = "".join(out) + texts[r][reach:]
            columns = list(b.columns)
            if changed:
                names = b.schema.names
                columns[names.index("text")] = pa.array([changed.get(r, t) for r, t in enumerate(texts)], pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pa.array([len(changed[r]) if r in changed else n for r, n in enumerate(columns[k].to_pylist())], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
