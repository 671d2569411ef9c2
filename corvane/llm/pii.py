"""Personal data: base patterns, and spans that a linear-chain conditional random field adds.

The base patterns find e-mail addresses, IP addresses, payment cards and international phone numbers. The random
field finds the same kinds in other forms: phone numbers without a leading plus, e-mail addresses with
"at" and "dot" in words or brackets, and addresses with blanks around their dots. Its labels (B- and I- of each kind,
and O) depend on word shapes of the token and its two neighbours on both sides, and on the label before. It is
trained on a small labelled table, made here from a few dozen marked templates, and decoded by Viterbi over
padded batches of sequences.

Whole texts are decoded, as sequences of some thousand tokens that end where no span can be.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import extend

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Fixed value: the longest e-mail address; the other kinds are shorter.
LONGEST = 254
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match begins where a run of digits does, as the run is taken whole; looking there only keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(\s*+)([^\W\d_]++|[0-9]++|[^\s])")


def luhn(digits: str) -> bool:
    """The check sum of payment cards."""
    odd = sum(map(int, digits[::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: a local part reaches back from its "@" as far as it can."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start and then kind."""
    found = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


# The labelled table's templates. [kind ...] marks a span; # is a random digit, w a random word.
TEMPLATES = """
call [phone (###) ###-####] today
phone: [phone ###-###-####] or w
tel [phone (0##) ###-####] w w
w w [phone (###) ###-####] w
reach me at [phone ### ### ####] please
my number is [phone ###.###.####] w
fax [phone ###-####-####], w
mobile [phone 0## ### ## ##] w
tel. [phone ###-####]
w , phone [phone (###) ### ####] .
write to [email w at w dot com] now
mail [email w.w [at] w.org] w
contact [email w (at) w (dot) net] please
email: [email w [at] w [dot] com]
w w [email w(at)w.com] w
send it to [email w dot w at w dot org] today
[email w ## at w dot example dot com] w
host [ip ## . ### . # . ##] down
ip [ip ###. ##. #. #] w
server at [ip ##[.]##[.]#[.]###] w
address [ip ### . ## . ## . #] w w
card [card #### / #### / #### / ####] w
visa [card ####.####.####.####] exp
card number: [card ####  ####  ####  ####] w
w w ################ w w
w ########## w w
w in #### and #### w
on ####-##-## w w
at ##:## w w
pages ###-### of w
w ##.## w w
w version #.#.# w
w version ##.# , w
$ ###,### w
invoice #####-## w w
w ## w ## w ##
isbn ###-#-##-######-# w
w at w w dot w
w was at w w
a dot on the w
the dot . w at w
w w w w
chapter # . # . # w
w ### w
w #,###.## w
id ########-#### w
w (##) w w
w [#] w [##] w
w (####) w
w ############## w w w
token = "w#w##w###w#" w
w |  w | ## | w
w $$$ w %%% w ## ***
ratio #:# or #/# w
tel w w w
call w at ## w
from ## to ## w
w @ w w
W w . W w , at w w . W w ################ w w w
w at w w w , w . W w w ################ . W
w w at w w . W w w
W . w at w ################ w w . W w
w w , w at w w. W w.
w ################ w. W at w w. W
follow @w on w
w@w w
room ###-# w
w # - # - # w
section ##.##.## w
w w w at w w , w . W w w w w w w at w w w w . W w w , w w w w w w . W w w at w w w w w w w w w w , w w w w . W w w w w w .
W at w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w w
w $$$ w %%% w *** w ### w &&& w $$$ at w w . W *** w , w w $$$ w w w w w w w at w . W w w w w , w w w w
w w w w w w w w w w w w w w w w [phone (###) ###-####] w w w w w w w w w w w , w w w w w w w w w . W w at w w .
W w w w w w , w w w at w w w w w w w w w w . W w w w [email w at w dot com] w w w w w w w . W w w w w w w w w w at w w
w w w w w . W w w w w w w w w w w w w w w w w w w [phone ### ### ####] . W w w w w w w w , w w at w w
w w w w w w w w w w . w w w w w [card #### / #### / #### / ####] w w w w w w , w w w w w w w at w w w w w w w w w .
[phone +## ### #######] w
w [email w@w.com] w
w [ip ##.##.##.##] w
w [card ################] card w
""".strip().split("\n")


def labelled_table(copies: int = 8, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of ``copies`` fillings of each template."""
    draw = random.Random(seed)
    parts = ["an", "er", "th", "on", "re", "lo", "mi", "ka", "ver", "sch", "qui", "os", "ta", "ing", "é", "ñ"]
    rows = []
    for template in TEMPLATES * copies:
        text, spans, opened = "", [], None
        for piece in re.findall(r"\[(?:email|ip|card|phone) |\[at\]|\[dot\]|\[\.\]|\[#+\]|\]|#|\bw\b|.", template):
            if piece[:-1] in ("[email", "[ip", "[card", "[phone"):
                opened = (len(text), KINDS.index(piece[1:-1]))
            elif piece == "]" and opened:
                spans.append((opened[0], len(text), opened[1]))
                opened = None
            elif piece == "w":
                word = "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
                text += word.capitalize() if draw.random() < 0.15 else word
            else:
                text += "".join(str(draw.randrange(10)) if c == "#" else c for c in piece)
        rows.append((text, spans))
    return rows


#: Words that are features of their own.
LEXICON = frozenset("at dot com org net phone tel telephone call mobile fax email mail contact card visa number ip host server address version pages isbn invoice id chapter section token".split())


def shape(token: str, spaced: bool) -> str:
    """Word shape: digits by count, punctuation by itself, words by case and length; a leading blank marks white space before."""
    if token[0].isdigit() and token[0] <= "9":
        s = f"9x{len(token) if len(token) < 13 else '13-19' if len(token) < 20 else '20+'}"
    elif not token[0].isalpha():
        s = token if token < "\x7f" else "symbol"
    elif (low := token.lower()) in LEXICON:
        s = low
    else:
        s = ("X" if token.isupper() else "Xx" if token[0].isupper() else "x") + ("short" if len(token) < 3 else "")
    return " " * spaced + s


class _Shapes(dict):
    """Shapes of the tokens met, with or without white space before; begun anew when there are too many."""

    def __init__(self, spaced: bool):
        self.spaced = spaced

    def __missing__(self, token: str) -> str:
        if len(self) >= 200_000:
            self.clear()
        self[token] = found = shape(token, self.spaced)
        return found


_SPACED, _CLOSE = _Shapes(True), _Shapes(False)


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, shape) of tokens. The first one counts as having white space before it."""
    out, end, first = [], 0, True
    for gap, token in _TOKEN.findall(text.rstrip()):  # white space at the end would be tried from each of its places
        start = end + len(gap)
        end = start + len(token)
        out.append((start, end, (_SPACED if gap or first else _CLOSE)[token]))
        first = False
    return out


OFFSETS = (-2, -1, 0, 1, 2)


class CRF:
    """Weights of (offset, shape, label) features and of label transitions."""

    def __init__(self, shapes: dict[str, int]):
        self.shapes, k = shapes, len(LABELS)
        # row 0 stands for shapes not seen in training, row 1 for places outside the sequence
        self.emit = np.zeros((len(OFFSETS), len(shapes) + 2, k))
        self.move = np.zeros((k, k))
        self.first = np.zeros(k)
        self.barred = np.zeros((k, k))
        for j, name in enumerate(LABELS):
            if name[0] == "I":
                for i, before in enumerate(LABELS):
                    if before[2:] != name[2:]:
                        self.barred[i, j] = -1e4

    def encode(self, sequences: list[list[tuple[int, int, str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Shape numbers (sequence, place, offset) and lengths."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        pad = np.ones((len(sequences), int(lengths.max(initial=0)) + 4), np.int64)
        for k, s in enumerate(sequences):
            pad[k, 2 : 2 + len(s)] = [self.shapes.get(x, 0) for _, _, x in s]
        return np.stack([pad[:, 2 + o : pad.shape[1] - 2 + o] for o in OFFSETS], 2), lengths

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][codes[:, :, k]] for k in range(len(OFFSETS)))

    def starts(self) -> np.ndarray:
        return self.first + np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])

    def viterbi(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels (sequence, place) of a padded batch; 0 (O) in the padding."""
        n, length, _ = codes.shape
        score = self.scores(codes)
        move = self.move + self.barred
        best = score[:, 0] + self.starts() if length else np.zeros((n, len(LABELS)))
        back = np.zeros((length, n, len(LABELS)), np.int8)
        for t in range(1, length):
            step = best[:, :, None] + move
            back[t] = step.argmax(1)
            best = np.where((t < lengths)[:, None], step.max(1) + score[:, t], best)
        out = np.zeros((n, length), np.int8)
        label = best.argmax(1)
        for t in range(length - 1, -1, -1):
            on = t < lengths
            out[on, t] = label[on]
            if t:
                label = np.where(on, back[t][np.arange(n), label], label)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _gaps(crf: CRF, codes: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> list[np.ndarray]:
    """Observed less expected counts of all features, by forward and backward sums over a padded batch."""
    n, length, _ = codes.shape
    size = len(LABELS)
    mask = np.arange(length) < lengths[:, None]
    one = np.eye(size)[gold] * mask[:, :, None]
    move_gap = sum(one[:, t - 1].T @ one[:, t] for t in range(1, length))
    score, move = crf.scores(codes), crf.move + crf.barred
    ahead, behind = np.zeros((length, n, size)), np.zeros((length, n, size))
    ahead[0] = score[:, 0] + crf.starts()
    for t in range(1, length):
        ahead[t] = np.where(mask[:, t, None], _log_sum(ahead[t - 1][:, :, None] + move, 1) + score[:, t], ahead[t - 1])
    whole = _log_sum(ahead[-1], 1)
    for t in range(length - 1, 0, -1):
        tail = score[:, t] + behind[t]
        both = np.exp(ahead[t - 1][:, :, None] + move + tail[:, None, :] - whole[:, None, None]) * mask[:, t, None, None]
        move_gap = move_gap - both.sum(0)
        behind[t - 1] = np.where(mask[:, t, None], _log_sum(move + tail[:, None, :], 2), 0.0)
    p = np.exp(ahead.transpose(1, 0, 2) + behind.transpose(1, 0, 2) - whole[:, None, None]) * mask[:, :, None]
    gap = (one - p).reshape(-1, size)
    emit = np.zeros_like(crf.emit)
    for k in range(len(OFFSETS)):
        np.add.at(emit[k], codes[:, :, k].ravel(), gap)
    return [emit, move_gap, (one - p)[:, 0].sum(0)]


def train(table: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 150, rate: float = 0.2, decay: float = 2e-3) -> CRF:
    """Maximum likelihood over the whole table at once, by Adam. Short and long sequences are padded apart."""
    rows = sorted(((tokens_of(t), spans) for t, spans in table), key=lambda x: len(x[0]))
    crf = CRF({s: i + 2 for i, s in enumerate(sorted({x for q, _ in rows for _, _, x in q}))})
    batches = []
    for part in ([r for r in rows if len(r[0]) <= 24], [r for r in rows if len(r[0]) > 24]):
        if part:
            codes, lengths = crf.encode([q for q, _ in part])
            gold = np.zeros(codes.shape[:2], np.int64)
            for k, (q, spans) in enumerate(part):
                for s, e, kind in spans:
                    inside = [t for t, (a, b, _) in enumerate(q) if s <= a and b <= e]
                    gold[k, inside] = 2 + 2 * kind
                    gold[k, inside[0]] = 1 + 2 * kind
            batches.append((codes, lengths, gold))
    params = [crf.emit, crf.move, crf.first]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        every = [_gaps(crf, *batch) for batch in batches]
        for x, g, (m, v) in zip(params, [sum(part) for part in zip(*every, strict=True)], state, strict=True):
            g = g / len(rows) - decay * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return crf


@functools.cache
def default_model() -> CRF:
    """The random field of the built-in labelled table, trained once in a process."""
    return train(labelled_table())


def sequences(tokens: list[tuple[int, int, str]], size: int = 2000, clear: int = 10) -> list[list[tuple[int, int, str]]]:
    """The tokens of a text as sequences of ``size`` to twice as many, so that a batch stays small whatever a text's length.

    A sequence ends where neither the ``clear`` tokens before nor those after could be part of a span (no digit, "@", "at", "dot" or
    bracket); only text with no such place in ``size`` tokens is cut at twice the size.
    """
    out, start = [], 0
    while len(tokens) - start > 2 * size:
        seen, cut = 0, start + 2 * size
        for i in range(start + size - clear, start + 2 * size):
            seen = 0 if _marks_span(tokens[i][2]) else seen + 1
            if seen == 2 * clear:
                cut = i + 1 - clear
                break
        out.append(tokens[start:cut])
        start = cut
    return [*out, tokens[start:]] if start < len(tokens) else out


def _marks_span(form: str) -> bool:
    form = form.lstrip()
    return form.startswith("9x") or form in ("@", "at", "dot", "(", "[", ")", "]")


def plausible(text: str, kind: int) -> bool:
    """Whether the length and the digits of an added span suit its kind."""
    d = digits_of(text)
    if len(text) > LONGEST:
        return False
    if kind == 0:
        return not re.search(r"[0-9]{9}|[.,;:!?]\s", text) and bool(re.search(r"(?i)\bat\b.*(\bdot\b|\.)", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15 and bool(re.search(r"[^0-9]", text))


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], crf: CRF, batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Plausible spans of the random field that overlap no base span."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    work = []
    for k, text in enumerate(texts):
        work += [(len(q), k, q) for q in sequences(tokens_of(text))]
    work.sort(key=lambda x: x[0])
    at = 0
    while at < len(work):
        longest = work[min(at + batch, len(work)) - 1][0]
        part = work[at : at + max(1, min(batch, 200_000 // max(1, longest)))]  # the padded batch stays small
        at += len(part)
        labels = crf.viterbi(*crf.encode([q for *_, q in part]))
        for row in np.flatnonzero(labels.any(1)).tolist():
            _, k, q = part[row]
            opened = None
            for t, (s, e, _) in enumerate([*q, (0, 0, "")]):
                name = LABELS[labels[row, t]] if t < len(q) else "O"
                if opened and name[0] != "I":
                    s0, e0, kind = opened
                    if plausible(texts[k][s0:e0], kind) and not any(x < e0 and s0 < y for x, y, _ in base[k]):
                        out[k].append(opened)
                    opened = None
                if name[0] == "B":
                    opened = (s, e, KINDS.index(name[2:]))
                elif name[0] == "I" and opened:
                    opened = (opened[0], e, opened[2])
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), crf: CRF | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and the columns of ``keep``.

    The counts and base_sha256 are of the base patterns' spans, as kind:start:end in code points with the
    end exclusive, by start and then kind, comma-joined; spans has all spans in that form. A null text
    counts as empty. Repeated rows are rows of their own; an empty table gives an empty result. Other columns are not
    read but for those of ``keep``, which may have any name that the result's own columns don't have.
    """
    model = crf or default_model()
    df = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"), *[docs[c].alias(f"_keep_{k}") for k, c in enumerate(keep)])

    def start():
        def joined(spans):
            return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)

        def make(batch):
            texts = batch["_text"].to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            every = [sorted([*b, *m], key=lambda x: (x[0], x[2])) for b, m in zip(base, more, strict=True)]
            counts = [[sum(x[2] == k for x in b) for b in base] for k in range(len(KINDS))]
            return [*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], [joined(x) for x in every]]

        return make

    new = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    found = extend(df, new, start)
    return found.select(F.col("_id").alias(id_col), *[x.split()[0] for x in new.split(", ")], *[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)])
