"""Personal data: checked patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers with a plus; matches that
fail their check are dropped. The field adds what patterns miss: phone numbers without a plus, addresses with a
written-out at sign or without a dot, IP addresses of the sixth version. It is trained by gradient ascent on the
likelihood (forward-backward, all sentences at once) from a small labelled table: phrases around a slot, each
met with several forms of numbers, where the same forms stand in phrases that ask for them and in phrases about
orders, pages or dates. The table may be replaced. Documents are decoded by Viterbi in numpy batches.

Only signal words (with a digit, an at sign or a written-out one), and CONTEXT words on either side, are decoded.
This is exact: a word that is none and has none beside it is outside by a hard constraint of the field, as an
inside label follows its own kind only by another.

Null and empty texts have no spans. Offsets count code points; whole texts are read. A span of the field that
meets a pattern's match, kept or dropped, is left out. Repeated rows come out each for itself; an empty table
gives no rows. All columns of the documents are kept, but one called as one that is added gives way to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forgotten, numbered, row_blocks, table, text_buffers

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGNAL = table(b"0123456789@")
CONTEXT = 3
#: Emissions that a worker keeps.
CACHED = 20_000
#: Text that a worker looks at together.
BLOCK_BYTES = 1 << 20
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

#: Phrases of the labelled table: {} is a slot for the forms of its list; several phrases share a line.
PHONE_PHRASES = "call me at {} tomorrow|please phone {} for the details|Tel. {} or write|his number is {} he said|reach us on {} after noon|mobile: {} any time|you may ring {} today|Telefon {} bitte|dial {} now|text me on {} please|Phone: {}|fax {} to the office|my cell is {} and|call {}|téléphone {} le matin|teléfono {} hoy|Office: {}|ruf mich unter {} an|hotline {} is open|or by phone at {} until five|whatsapp {} anytime|contact number {} only|desk {} extension 7|Fax: {}|Tel: {}|you can reach him at {} every day|ring her on {} at home".split("|")
OTHER_PHRASES = "order {} shipped|invoice number {} is due|the order of {} was paid|ticket {} was closed|account {} was opened|isbn {} was printed|pages {} of the book|serial number {} failed|see case {} for more|tracking code {} arrived|reference {} applies|article {} says|item {} is sold out|model {} weighs more|Rechnung {} vom Mai|facture {} du mois|pedido {} enviado|batch {} passed the test|part no. {} fits|the sum of {} was counted|Order number {} today|room {} on floor 2|policy {} expired|the code {} was removed|bill {} from last year|parcel {} is late|flight {} landed|id {} in the table|version {} is out|total {} units".split("|")
MAIL_PHRASES = "write to {} soon|contact {} for help|mail {} please|the address is {} now|my e-mail {} works|email: {}|send it to {} today|reach me under {} or|from {} to all|E-Mail {} bitte|courriel {} merci|user {} wrote".split("|")
HOST_PHRASES = "server {} is down|connect to {} now|the address {} answers|ping {} first|host {} was seen|from {} to the gateway|dns {} resolves|ip {} was blocked|a request of {} came|route via {} only|login from {} failed".split("|")
NOT_MAIL = "follow {} on the site|thanks to {} for this|as {} said|by {} today".split("|")
NOT_HOST = "between {} and noon|at {} sharp|the ratio {} was used|mac {} joined|duration {} in all|device {} was paired|verse {} reads".split("|")
PHONES = "(555) 555-7788|555-678-9955|0555 6677889|555.678.5599|(089) 5566-7788|555 567 8899|07557 667788|00 55 6677 8899|0555/667788|5556789955|020 5567 8899|(0555) 667 788|01 55 66 77 88|555-5678".split("|")
MAILS = "anna (at) mail.example.org|bob [at] site.example.com|carla @ firm.example.net|dora.k(at)example.com|eva[at]mail.example.net|evan@localhost|f.g@intern|hal (AT) example.org|ida [at] mail.example.com".split("|")
HOSTS = "fe85::5a6b:77ff:fe88:9955|2555:db8::8a5e:0:7556|2555:0db8:85a5::8a5e:0575:7556|::5|2a55:45::55|fd55:6:7::8|2555:db8:5:6:7:8:9:5".split("|")
NAMES = "@anna|@bob_7|@|@the|@c5".split("|")
TIMES = "10:55|11:30:55|5:6|00:5A:6B:7C:8D:9E|55:66:77:88:99:aa|3:16|1:25:55".split("|")
NUMBERS = "1999|56|7,500|4.0|5.6.7|$59.95|2019-05-06|07/08/2019|556677|89|ABC-567|155-168|978-5-566-77889-5|6th|0.556|-5.5|X5-600|55kg|55-68|55 million|1 555 667|5a6b7c8d9e5f6a7b8c|60 %|10-12|1,555,667.50".split("|")
PLAIN = "in {} and 2016 we sold more|about {} people came|chapter {} explains it|it costs {} or less|born on {} in town|between {} and 60|in game {} of the year|dated {} and signed|see line {} and note 5|the {} train left|weighs {} at most|key {} was changed|since {} it grew|values of {} were seen".split("|")
#: Words whose company tells what a number is.
COMPANY = {
    "phone": "call phone tel telephone telefon téléphone teléfono mobile cell handy fax ring dial reach text sms whatsapp hotline helpline office desk appelez llame ruf rufen anrufen",
    "other": "order invoice ticket account isbn issn page pages serial case tracking reference ref article item model rechnung bestellung facture commande pedido factura batch part sum room policy code bill parcel flight id version total row score token chapter line section volume no nr sku lot zip",
    "mail": "mail e-mail email courriel write contact send",
    "host": "server host ip ping dns connect gateway router route login request node resolver",
    "count": "about between since in chapter costs born dated weighs",
    "unit": "people units items million percent euro dollars kg years shipped",
}
CLASS_OF = {w: k for k, ws in COMPANY.items() for w in ws.split()}
WRITTEN_AT = re.compile(r"[(\[{<]at[)\]}>]", re.I)
WRITTEN_AT_BYTES = re.compile(WRITTEN_AT.pattern.encode(), re.I)
EDGES = ".,;:!?\"'#"


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """Sentences as words and labels: each phrase with two forms of its slot's list, dealt in turn."""
    out = []
    lists = [(PHONE_PHRASES, PHONES, "phone"), (OTHER_PHRASES, PHONES, None), (OTHER_PHRASES, NUMBERS, None), (PLAIN, NUMBERS, None), (PHONE_PHRASES, ["five", "once", "2019"], None)]
    lists += [(MAIL_PHRASES, MAILS, "email"), (NOT_MAIL, NAMES, None), (HOST_PHRASES, HOSTS, "ip"), (NOT_HOST, TIMES, None), (PHONE_PHRASES, PHONES, "phone"), (OTHER_PHRASES, PHONES, None), (PLAIN, PHONES[:7], None)]
    for at, (phrases, forms, kind) in enumerate(lists):
        for n, phrase in enumerate(phrases):
            for v in range(2):
                own = forms[(2 * n + v + at) % len(forms)].split()
                left, right = phrase.split("{}")
                ending = right.split() if not right or right[0] == " " else [right]
                labels = ["O"] * len(own) if kind is None else [("B-" if i == 0 else "I-") + kind for i in range(len(own))]
                out.append((left.split() + own + ending, ["O"] * len(left.split()) + labels + ["O"] * len(ending)))
    return out


def shape(word: str) -> str:
    """Letters as x, capitals as X, digits as d with their number up to 9; other characters as they are; runs joined."""
    out = re.sub(r"[A-Z]+", "X", re.sub(r"[^\W\d_A-Z]+", "x", word[:64]))
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", out)


def plain(word: str) -> bool:
    """Whether a word is no signal."""
    return not any(c in "0123456789@" for c in word) and not WRITTEN_AT.search(word)


def company(word: str) -> str:
    return CLASS_OF.get(word.strip(EDGES + "()").lower(), "w")


def rough(word: str) -> str:
    """The shape of a neighbour; words that are no signals are all alike."""
    return "w" if plain(word) else re.sub(r"d[0-9]", "d", shape(word.strip(EDGES))) if len(word) < 40 else "long"


def numeric(word: str) -> bool:
    word = word.strip(EDGES)
    return any(c in "0123456789" for c in word) and all(c in "0123456789()./-+" for c in word)


def features(words: list[str], i: int) -> list[str]:
    word = words[i]
    before = rough(words[i - 1]) if i else "w"
    after = rough(words[i + 1]) if i + 1 < len(words) else "w"
    if plain(word):
        return ["quiet"] if before == after == "w" else ["bias", "own=w", f"before={before}", f"after={after}"]
    bare = word.strip(EDGES) if len(word) < 64 else "long"
    a = b = i
    if numeric(word):  # the run of numbers it stands in
        while a and i - a < 8 and numeric(words[a - 1]):
            a -= 1
        while b + 1 < len(words) and b - i < 8 and numeric(words[b + 1]):
            b += 1
    digits = sum(c in "0123456789" for w in words[a : b + 1] for c in w[:64])
    size = "few" if digits < 7 else "some" if digits <= 15 else "many"
    left = {company(w) for w in words[max(0, a - 4) : a] if plain(w)} - {"w"}
    near = next((company(w) for w in reversed(words[max(0, a - 4) : a]) if plain(w) and company(w) != "w"), "none")
    out = ["bias", f"own={rough(word)}", f"before={before}", f"after={after}", f"pair={before}|{rough(word)}", f"shape={shape(bare)}", f"size={size}"]
    out += [f"near={near}", f"near={near}|{size}", f"near={near}|{size}|{i > a}", f"first={a == i}|{size}", f"next={company(words[b + 1]) if b + 1 < len(words) and plain(words[b + 1]) else 'none'}", f"begins={bare[:1] if not bare[:1].isalnum() else 'a'}"]
    out += [f"left={c}" for c in sorted(left)]
    colons = bare.count(":")
    six = bool(re.fullmatch(r"[0-9a-fA-F:]+", bare)) and ("::" in bare or colons == 7)
    out += [f"at={'@' in word}|{bool(WRITTEN_AT.search(word))}|{len(word) > 4}", f"dot={'.' in bare}", f"six={six}", f"mac={colons == 5}", f"letters={any(c.isalpha() for c in bare)}", f"money={any(c in '$%€£' for c in word)}"]
    return out


class Field:
    """The trained field: weights by feature, and transitions."""

    def __init__(self, sentences: list[tuple[list[str], list[str]]], steps: int = 110, rate: float = 0.4, decay: float = 2e-4):
        names: dict[str, int] = {}
        rows = [[[names.setdefault(f, len(names)) for f in features(w, i)] for i in range(len(w))] for w, _ in sentences]
        n, most, k = len(sentences), max(len(w) for w, _ in sentences), len(LABELS)
        x = np.zeros((n, most, len(names)))
        y = np.zeros((n, most), int)
        mask = np.zeros((n, most), bool)
        for s, (words, labels) in enumerate(sentences):
            for i, f in enumerate(rows[s]):
                x[s, i, f] = 1
            y[s, : len(labels)] = [LABELS.index(v) for v in labels]
            mask[s, : len(words)] = True
        weights, moves = np.zeros((len(names), k)), np.zeros((k, k))
        flat = x.reshape(-1, len(names))
        gold_w = flat.T @ (np.eye(k)[y] * mask[:, :, None]).reshape(-1, k)
        gold_m = np.zeros((k, k))
        np.add.at(gold_m, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
        square_w, square_m = np.zeros_like(weights), np.zeros_like(moves)
        for _ in range(steps):
            node = (flat @ weights).reshape(n, most, k)
            alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
            alpha[:, 0] = node[:, 0]
            for t in range(1, most):
                step = alpha[:, t - 1, :, None] + moves
                top = step.max(axis=1, keepdims=True)
                new = np.log(np.exp(step - top).sum(axis=1)) + top[:, 0] + node[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                step = moves + (node[:, t + 1] + beta[:, t + 1])[:, None, :]
                top = step.max(axis=2, keepdims=True)
                new = np.log(np.exp(step - top).sum(axis=2)) + top[:, :, 0]
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            top = alpha[:, -1].max(axis=1)
            logs = np.log(np.exp(alpha[:, -1] - top[:, None]).sum(axis=1)) + top
            own = np.exp(alpha + beta - logs[:, None, None]) * mask[:, :, None]
            pair = alpha[:, :-1, :, None] + moves + (node[:, 1:] + beta[:, 1:])[:, :, None, :] - logs[:, None, None, None]
            pair = np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]
            slope_w = (gold_w - flat.T @ own.reshape(-1, k)) / n - decay * weights
            slope_m = (gold_m - pair.sum(axis=(0, 1))) / n - decay * moves
            square_w += slope_w**2
            square_m += slope_m**2
            weights += rate * slope_w / np.sqrt(square_w + 1e-8)
            moves += rate * slope_m / np.sqrt(square_m + 1e-8)
        for a, left in enumerate(LABELS):  # an inside label follows its own kind only
            for b, right in enumerate(LABELS):
                if right[0] == "I" and left[2:] != right[2:]:
                    moves[a, b] = -1e3
        if "quiet" in names:
            weights[names["quiet"], 1:] = -1e3
        self.names, self.weights, self.moves, self.cache = names, weights, moves, {}

    def emission(self, words: list[str], i: int) -> np.ndarray:
        key = tuple(k for f in features(words, i) if (k := self.names.get(f)) is not None)
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            found = self.cache[key] = self.weights[list(key)].sum(axis=0)
        return found

    def decode(self, chains: list[list[np.ndarray]]) -> list[list[int]]:
        """Best paths of chains of emissions, in batches of like lengths; outside words stand at both ends."""
        out: list = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda c: len(chains[c]))
        at = 0
        while at < len(order):
            most = len(chains[order[at]])
            end = at
            while end < len(order) and len(chains[order[end]]) == most and (end - at) * most < 65536:
                end += 1
            some = order[at:end]
            node = np.array([chains[c] for c in some])
            score, back = node[:, 0] + self.moves[0], []
            for t in range(1, most):
                step = score[:, :, None] + self.moves
                back.append(step.argmax(axis=1))
                score = step.max(axis=1) + node[:, t]
            path = [(score + self.moves[:, 0]).argmax(axis=1)]
            for b in reversed(back):
                path.append(b[np.arange(len(some)), path[-1]])
            paths = np.array(path[::-1]).T
            for c, p in zip(some, paths):
                out[c] = p.tolist()
            at = end
        return out


_FIELDS: dict = {}


def field(sentences=None) -> Field:
    """The field of the built-in table, trained once a process."""
    if sentences is not None:
        return Field(sentences)
    if not _FIELDS:
        _FIELDS[0] = Field(labelled_table())
    return _FIELDS[0]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the checked patterns, and the matches that failed."""
    good, failed, last = [], [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            good.append((0, start, m.end()))
            last = m.end()
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1:
                ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
            elif kind == 2:
                ok = 13 <= len(digits) <= 19 and luhn(digits)
            else:
                ok = 9 <= len(digits) <= 15
            if ok:
                good.append((kind, m.start(), m.end()))
            elif kind == 3 or kind == 1 or len(digits) >= 13:
                failed.append((m.start(), m.end()))
    return good, failed


def plausible(kind: int, text: str) -> bool:
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return "@" in text[1:] or bool(WRITTEN_AT.search(text))
    if kind == 1:
        return text.count(":") >= 2
    return 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


WORDS = re.compile(r"\S+")


class Finder:
    """Finds the spans of many texts, decoding all their chains together."""

    def __init__(self, model: Field):
        self.model = model

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans and its added spans."""
        out, chains, about = [], [], []
        for n, text in enumerate(texts):
            good, failed = base_spans(text)
            out.append((sorted(good), []))
            taken = sorted([(s, e) for _, s, e in good] + failed)
            words = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(text)]
            names = [w[0] for w in words]
            marks = [i for i, w in enumerate(names) if not plain(w)]
            k = 0
            while k < len(marks):
                a, b = marks[k], marks[k]
                while k < len(marks) and marks[k] - b <= 2 * CONTEXT:
                    b = marks[k]
                    k += 1
                a, b = max(0, a - CONTEXT), min(len(words), b + CONTEXT + 1)
                chains.append([self.model.emission(names, i) for i in range(a, b)])
                about.append((n, words[a:b], taken))
        for (n, words, taken), path in zip(about, self.model.decode(chains)):
            i = 0
            while i < len(path):
                if LABELS[path[i]][0] != "B":
                    i += 1
                    continue
                kind, j = LABELS[path[i]][2:], i + 1
                while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                    j += 1
                start, end = words[i][1], words[j - 1][2]
                text = texts[n]
                while end > start and text[end - 1] in ".,;:!?\"'":
                    end -= 1
                while start < end and text[start] in "\"'<" and not WRITTEN_AT.match(text, start):
                    start += 1
                number = KINDS.index(kind)
                if plausible(number, text[start:end]) and not any(s < end and start < e for s, e in taken):
                    out[n][1].append((number, start, end))
                i = j
        return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind's name."""
    out, at, held = [], 0, None
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if held and s < held[1]:
            held = (held[0], max(e, held[1]), held[2])
            continue
        if held:
            out += [text[at : held[0]], f"<{KINDS[held[2]].upper()}>"]
            at = held[1]
        held = (s, e, k)
    if held:
        out += [text[at : held[0]], f"<{KINDS[held[2]].upper()}>"]
        at = held[1]
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text_col: str = "text", sentences=None) -> DataFrame:
    """All columns of docs, with n_email, n_ip, n_card, n_phone, base (written spans of the patterns), spans (all) and redacted."""
    added = [*(f"n_{k}" for k in KINDS), "base", "spans", "redacted"]
    rows, own, at = numbered(docs, added, text_col)
    names = rows.columns
    model = docs.sparkSession.sparkContext.broadcast(field(sentences))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        forgotten()
        finder = Finder(model.value)
        for batch in batches:
            column = batch.column(at)
            data, offsets = text_buffers(column)
            counts = np.zeros((4, batch.num_rows), np.int64)
            base, spans = [""] * batch.num_rows, [""] * batch.num_rows
            texts_out = [column.slice(0, 0)]
            for a, b in row_blocks(offsets, BLOCK_BYTES):
                own, block = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
                raw = block.tobytes()
                more = np.zeros(b - a, bool)
                more[np.searchsorted(own, np.flatnonzero(SIGNAL[block]), "right") - 1] = True
                for m in WRITTEN_AT_BYTES.finditer(raw):
                    more[np.searchsorted(own, m.start(), "right") - 1] = True
                hit = np.flatnonzero(more)
                new: dict[int, str] = {}
                for lo in range(0, len(hit), 500):
                    part = hit[lo : lo + 500].tolist()
                    texts = [raw[own[i] : own[i + 1]].decode() for i in part]
                    for i, text, (good, extra) in zip(part, texts, finder.find(texts)):
                        for k, _, _ in good:
                            counts[k, a + i] += 1
                        base[a + i], spans[a + i] = written(good), written(good + extra)
                        if good or extra:
                            new[i] = redacted(text, good + extra)
                some = column.slice(a, b - a)
                if new:
                    text = some.to_pylist()
                    for i, x in new.items():
                        text[i] = x
                    some = pa.array(text, column.type)
                texts_out.append(some)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.concat_arrays(texts_out)], names=[*names, *added])

    out = rows.mapInArrow(run, f"{kinds}, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, redacted string")
    return out.toDF(*own, *added)
