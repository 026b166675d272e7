"""Personal data: emails, IP addresses, payment cards and phone numbers, also where they are disguised.

The base spans are what plain patterns match. Then transducers rewrite the text: homoglyphs become the ASCII characters
they look like, invisible characters go, spelled digits become digits, and disguised "at" and "dot" become @ and a dot.
As a number word may or may not belong to the digits beside it, the text is read with all, some and none rewritten.
Each rewritten character knows the source range it stands for, so what the patterns find in the rewritten text is
mapped back to spans of the source. Such a span is added if it holds something rewritten and overlaps no base span of
its kind. Offsets are code points, ends are exclusive.

Null is as the empty text, which has no spans; whole texts of any length are read in linear time; repeated rows are
treated alike.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits matches either from its beginning or not at all, so only beginnings are tried.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]+")

#: Characters by what they look like, those of other scripts and symbols as in Unicode's table of confusables. Fixed values.
ALIKE = {
    "A": "ΑАᎪᗅꓮ", "B": "ΒВᏴᗷꓐꞴ", "C": "ϹСᏟⲤꓚ", "D": "Ꭰᗞᗪꓓ", "E": "ΕЕᎬ⋿ⴹꓰ", "F": "ϜᖴꓝꞘ", "G": "ԌᏀᏳꓖ", "H": "ΗНᎻᕼⲎꓧ",
    "I": "ΙІӀⲒꓲᛁⵏ", "J": "ͿЈᎫᒍꓙ", "K": "ΚКᏦⲔᛕꓗ", "L": "ᏞᒪⳐꓡ", "M": "ΜМϺᎷᗰᛖⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳⵔዐଠ", "P": "ΡРᏢᑭⲢꓑ",
    "Q": "ⵕ", "R": "ƦᎡᏒᖇꓣ", "S": "ЅՏᏕᏚꓢ", "T": "ΤТᎢⲦꓔ⊤⟙", "U": "Սሀᑌꓴ∪⋃", "V": "ѴᏙᐯⴸꓦ", "W": "ԜᎳᏔꓪ", "X": "ΧХⲬⵝᚷꓫꞳ╳", "Y": "ΥҮⲨᎩᎽꓬ", "Z": "ΖᏃꓜ",
    "a": "ɑαа⍺", "b": "ƄЬᏏᑲᖯ", "c": "ϲсᴄⲥꮯ", "d": "ԁᏧᑯꓒ", "e": "еҽ℮ꬲ", "f": "ꞙꬵքẝ", "g": "ƍɡᶃց", "h": "һհᏂ", "i": "іıɩɪιӏꙇᎥꭵ⍳", "j": "јϳ", "l": "ǀƖ",
    "n": "ոռ", "o": "οоσօჿⲟᴏᴑꬽסഠဝ", "p": "рρϱ⍴ⲣ", "q": "ԛգզ", "r": "гᴦⲅꭇꭈꮁ", "s": "ѕƽꜱꮪ", "u": "ʋυսᴜꭎꭒꞟ", "v": "νѵᴠ∨⋁טꮩ", "w": "ɯѡԝաᴡꮃ",
    "x": "хᕁᕽ×⤫⤬⨯", "y": "уүɣʏγყỿᶌꭚ", "z": "ᴢꮓ", "0": "〇", "2": "ƧϨꙄᒿ", "3": "ЗӠƷȜꝪⳌ", "4": "Ꮞ", "5": "Ƽ", "6": "бᏮⳒ", "8": "Ȣȣ", "9": "ᏭⳊꝮ",
    ".": "․܁܂꘎ꓸ。", "-": "‐‒–⁃˗−➖Ⲻ", "+": "᛭➕",
}


def lookalikes() -> dict[str, str]:
    """Other characters and the ASCII ones that they stand for: by compatibility, as decimal digits, or by their looks."""
    alike, out = {c: plain for plain, chars in ALIKE.items() for c in chars}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        form = unicodedata.normalize("NFKC", c)
        plain = alike.get(c) or (str(n) if (n := unicodedata.decimal(c, None)) is not None else alike.get(form, form))
        if len(plain) == 1 and plain.isascii():
            out[c] = plain
    return out


LOOKALIKES = lookalikes()
#: Characters and ranges that show nothing.
GONE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e0fff"
INVISIBLE = re.compile(f"[{GONE}]")
#: All that may be replaced; beyond the first plane a class is slow unless it is one range, so LOOKALIKES and INVISIBLE decide there.
OTHERS = re.compile(f"[{GONE[: GONE.index(chr(0xE0000))]}{''.join(c for c in LOOKALIKES if c < chr(0x10000))}{chr(0x10000)}-{chr(0x10FFFF)}]")
SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
WORDS = re.compile("|".join(SPELLED))
#: What may be between the digits of one number, or of the numbers of an address.
GAP, GAP_CHARS = re.compile(r"(?:[\x20().+-]++|dot(?![a-z]))*+"), "\x20().+-"
BRACKETS = re.compile(r"[\[({<][\x20]*+(?:(?P<at>at|@)|dot|\.)[\x20]*+[\])}>][\x20]*+", re.I | re.A)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NUMBER_DOT = re.compile(r"(?<=[0-9])[\x20]dot[\x20](?=[0-9])", re.I | re.A)
#: An at and all the labels that follow, joined by dots or spelled dots.
HOST = re.compile(r"(?P<at>@|(?<=[A-Za-z0-9_%+-])[\x20]at[\x20])(?P<host>[A-Za-z0-9-]++(?:(?:[\x20]dot[\x20]|\.)[A-Za-z0-9-]++)++)", re.I | re.A)
JOIN = re.compile(r"[\x20]dot[\x20]|\.", re.I | re.A)
LAST_LABEL = re.compile(r"(?!dot(?![A-Za-z]))[A-Za-z]{2,}+(?![0-9])", re.I | re.A)
#: After "at", these begin a phrase ("look at the dot on it") rather than a host, unless the last label is one of ENDINGS. Fixed values.
ARTICLES = frozenset("the a an this that these those each every his her its our their my your some any".split())
ENDINGS = frozenset("com net org edu gov info biz io co eu uk us de fr es it nl ch at ca ai jp ru au nz cn br mx kr se dk fi pl cz pt ie gr tr ua za dev app xyz online site".split())


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of local part, @ and domain: of each @ the local characters before it and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))
NEEDS = dict(zip(KINDS, ("@", ".", None, "+"), strict=True))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(find(text)) if NEEDS[kind] is None or NEEDS[kind] in text else [] for kind, find in FINDERS.items()}


class Rewritten:
    """A text that is edited step by step; each of its characters knows the source range it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), []

    def edited(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """With the ranges of the edits, which are in order, replaced; each replacement stands for the whole range."""
        if not edits:
            return self
        new, out, at = Rewritten(""), [], 0
        new.starts, new.ends, new.changed = [], [], list(self.changed)
        for start, end, chars in [*edits, (len(self.text), len(self.text), "")]:
            out += [self.text[at:start], chars]
            new.starts.extend(self.starts[at:start])
            new.ends.extend(self.ends[at:start])
            if end > start:
                new.starts.extend([self.starts[start]] * len(chars))
                new.ends.extend([self.ends[end - 1]] * len(chars))
                new.changed.append(self.starts[start])
            at = end
        new.text = "".join(out)
        return new

    def stands_for_more(self, at: int) -> bool:
        return self.ends[at] - self.starts[at] > 1


def other_edits(text: str) -> list[tuple[int, int, str]]:
    """Characters as those that they look like, and without those that show nothing."""
    found = ((m.start(), m.end(), m[0]) for m in OTHERS.finditer(text))
    return [(start, end, LOOKALIKES.get(c, "")) for start, end, c in found if c in LOOKALIKES or INVISIBLE.match(c)]


def bracket_edits(text: str) -> list[tuple[int, int, str]]:
    """Ats and dots in brackets, with the spaces around them."""
    edits, done = [], 0
    for m in BRACKETS.finditer(text):
        start = m.start()
        while start > done and text[start - 1] == " ":
            start -= 1
        done = m.end()
        edits.append((start, done, "@" if m["at"] else "."))
    return edits


def number_words(low: str) -> list[tuple[int, int]]:
    """Spelled digits of a text in lower case that have a digit or a spelled digit beside them; any other is a number by itself."""
    words = [m.span() for m in WORDS.finditer(low) if not ("a" <= low[m.start() - 1 : m.start()] <= "z" or "a" <= low[m.end() : m.end() + 1] <= "z")]
    out, done, joined = [], 0, False
    for i, (start, end) in enumerate(words):
        after = GAP.match(low, end).end()
        follows = i + 1 < len(words) and after == words[i + 1][0]
        if not (near := joined or follows or low[after : after + 1] in tuple("0123456789")):
            before = low[done:start].rstrip(GAP_CHARS)
            while before.endswith("dot"):
                before = before[:-3].rstrip(GAP_CHARS)
            near = before[-1:] in tuple("0123456789")
        if near:
            out.append((start, end))
        done, joined = end, follows
    return out


def spelled_edits(text: str, words: list[tuple[int, int]], runs: bool) -> list[tuple[int, int, str]]:
    """Spelled digits as digits that close up with neighbours one space or hyphen away: other spelled digits, and digits if not runs.

    With runs, spelled digits without a spelled neighbour stay.
    """
    edits = []
    for i, (start, end) in enumerate(words):
        before = i > 0 and words[i - 1][1] == start - 1 and text[start - 1] in " -"
        after = i + 1 < len(words) and words[i + 1][0] == end + 1 and text[end] in " -"
        if runs and not before and not after:
            continue
        if before or (not runs and start > 1 and text[start - 1] in " -" and text[start - 2] in "0123456789"):
            edits.append((start - 1, start, ""))
        edits.append((start, end, SPELLED[text[start:end].lower()]))
        if not runs and text[end : end + 1] in (" ", "-") and text[end + 1 : end + 2] in tuple("0123456789"):
            edits.append((end, end + 1, ""))
    return edits


def address_edits(now: Rewritten) -> list[tuple[int, int, str]]:
    """Spelled dots between numbers; spelled ats and dots of a host that ends in a word, and of the local part before it."""
    text = now.text
    edits, done = {(m.start(), m.end(), ".") for m in NUMBER_DOT.finditer(text)}, 0
    for m in HOST.finditer(text):
        (at, host), end = (m.start("at"), m.start("host")), m.end()
        joins = list(JOIN.finditer(text, host, end))
        while joins and not LAST_LABEL.match(text, joins[-1].end(), end):
            end = joins.pop().start()
        spelled = [j for j in joins if len(j[0]) > 1]
        hidden = spelled or any(now.stands_for_more(j.start()) for j in joins)
        if m["at"] != "@":
            last = joins and LAST_LABEL.match(text, joins[-1].end(), end)[0].lower()
            if not hidden or (text[host : joins[0].start()].lower() in ARTICLES and last not in ENDINGS):
                continue
            edits.add((at, host, "@"))
        elif not joins or not (hidden or now.stands_for_more(at)):
            continue
        edits.update((*j.span(), ".") for j in spelled)
        start = at
        while True:
            own = start
            while own > done and text[own - 1] in LOCAL:
                own -= 1
            if own == start or own - 5 <= done or text[own - 5 : own].lower() != " dot " or text[own - 6] not in LOCAL:
                break
            edits.add((own - 5, own, "."))
            start = own - 5
        done = end
    return sorted(edits)


def readings(text: str) -> list[Rewritten]:
    """The normalised text with all spelled digits as digits, with only runs of them, with none; only those that differ."""
    now = Rewritten(text)
    if not text.isascii():
        now = now.edited(other_edits(text))
    brackets = bracket_edits(now.text)
    now = now.edited(brackets)
    low = now.text.lower()
    if len(low) != len(now.text):
        low = now.text.translate(LOWER)
    words = number_words(low)
    addresses = brackets or " dot " in low  # nothing else leads to edits of addresses
    out: list[Rewritten] = []
    for edits in (spelled_edits(now.text, words, False), spelled_edits(now.text, words, True), []) if words else ([],):
        one = now.edited(edits)
        one = one.edited(address_edits(one)) if addresses else one
        if one.changed and all(one.text != x.text for x in out):
            out.append(one)
    return out


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only show in the normalised text: of the fullest reading first, of IP addresses of the plainest."""
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    read = readings(text)
    found = [base_spans(one.text) for one in read]
    for kind in KINDS:
        for one, spans in list(zip(read, found, strict=True))[:: -1 if kind == "ip" else 1]:
            if not spans[kind]:
                continue
            known, changed = sorted(base[kind] + added[kind]), sorted(one.changed)
            at, first = 0, 0
            for a, b in spans[kind]:
                start, end = one.starts[a], one.ends[b - 1]
                while first < len(changed) and changed[first] < start:
                    first += 1
                while at < len(known) and known[at][1] <= start:
                    at += 1
                if first < len(changed) and changed[first] < end and not (at < len(known) and known[at][0] < end):
                    added[kind].append((start, end))
    return added


def as_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in sorted(spans[kind]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the number of base spans of each kind, base_sha256 and spans (all, as kind:start:end) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text := text or "")
            added = added_spans(text, base)
            counts.append([len(base[kind]) for kind in KINDS])
            digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
            spans.append(as_text({kind: base[kind] + added[kind] for kind in KINDS}))
        columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests), pa.array(spans)], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = dict(df.dtypes)[id_col]
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), work, f"id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each span, base or added, replaced by its kind; spans that overlap are replaced together."""
    base = base_spans(text)
    added = added_spans(text, base)
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k in KINDS for s, e in base[k] + added[k]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the personal data in its texts replaced; null stays null."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda x: x if x is None else masked(x))

    return df.withColumn(text_col, mask(F.col(text_col)))
