"""Personal data in free text (problem 4): found, scored and replaced by typed placeholders.

Texts are scanned a batch at a time: one automaton marks literal anchors (name words, contexts, street words, at-signs) and two
expressions mark numbers; rules then look only at the anchors' surroundings. A number's score is that of its shape, its context words
and, where its shape has one, its checksum: without words that name an identity number, a shape with a checksum counts only if the
checksum holds, and one that fails sinks a number that is merely called a number. JSON escapes are read through without changing
anything outside the spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TYPES = ("EMAIL", "ID_NUMBER", "PHONE", "ADDRESS", "NAME")  # in order of precedence

# Words and contexts in English, German, Spanish and Chinese.
INTRODUCTIONS = ("my name is", "name is", "i am", "mi nombre es", "me llamo", "soy", "ich heiße", "ich bin", "mein name ist", "ansprechpartner ist", "ansprechpartnerin ist", "contact is", "contacto es", "姓名", "联系人", "我叫", "我是", "收件人")
CLOSINGS = ("regards,", "thanks,", "cheers,", "sincerely,", "yours,", "best,", "saludos,", "gracias,", "grüße,", "danke,")
SIGNED = tuple(f"{x} by" for x in ("signed", "signed off", "approved", "written", "sent", "reviewed", "prepared", "submitted", "requested", "reported", "checked"))
NAME_BEFORE = (*INTRODUCTIONS, *CLOSINGS, *SIGNED)
ROLES = tuple("caregiver nurse doctor patient client customer guest tenant landlord manager supervisor teacher student driver owner assistant colleague neighbour lawyer kundin mieter mieterin leiter leiterin kollege kollegin pfleger pflegerin paciente clienta gerente vecino vecina".split())
REQUESTS = ("loop in", "contact", "ask for", "speak to", "talk to", "write to", "notify", "invite")
PERSON_VERBS = tuple("called approved picks picked signed wrote asked said confirmed visited lives works phoned replied complained".split())
DEPARTMENTS = tuple(f"from {x}" for x in ("accounts", "sales", "support", "finance", "legal", "marketing", "billing", "operations"))
NAME_FIELDS = ("holder", "customer_name", "customer name", "full-name", "full_name", "full name", "fullname", "attn", "display_name", "contact_name", "contact name", "recipient", "patient", "employee", "nombre", "cliente", "kunde", "unterschrift")
TITLES = ("dr.", "mr.", "mrs.", "ms.", "prof.", "herr ", "frau ", "sr.", "sra.")
NOT_NAMES = frozenset("the a an and or of for module cluster theme rollout is was passed restarted service project team build release branch ticket when while until unless since because so if with to from in on at by per not plus see der die das el la los las un una und y monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
PHONE_WORDS = ("tel", "phone", "mobile", "cell", "call", "callback", "text me", "new number", "rückruf", "telefon", "llame", "teléfono", "móvil", "手机", "电话", "致电", "fax", "whatsapp", "handy")
ID_WORDS = ("passport", "pasaporte", "reisepass", "tax number", "tax id", "tax_id", "social insurance", "national identity", "national_id", "national id", "identity", "licence", "license", "dni", "nif", "nie", "ssn", "nino", "ausweis", "steuer", "führerschein", "sozialversicherung", "身份证", "护照", "税号", "驾照", "驾驶证", "社保", "id_number", "id number")
NUMBER_WORDS = ("number", "no.", "id", "nr", "nummer", "número", "号码")
OTHER_NUMBERS = ("order", "ticket", "part", "part number", "part no", "invoice", "batch", "build", "trace", "score", "ping", "window", "version", "release", "serial", "lot", "sku", "item", "tracking", "bestellung", "rechnung", "charge", "teil", "pedido", "factura", "lote", "pieza", "订单", "发票", "批次", "工单", "零件", "构建", "note", "route", "port", "commit", "job", "issue", "line")
STREETS = "street|road|lane|avenue|drive|close|court|terrace|way|crescent|square|place|boulevard|grove|gardens|mews|hill|row|walk|parade|highway"
STREETS_CUT = "st|rd|ln|ave|dr|blvd|ct|ter|cres"
GERMAN_STREETS = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ufer", "damm")
SPANISH_STREETS = ("calle", "avda", "avenida", "paseo", "plaza", "carrera", "ronda", "travesía")
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
DOUBLE_SURNAMES = ("欧阳", "司徒", "诸葛", "上官", "司马", "东方", "夏侯", "皇甫", "尉迟", "公孙", "慕容", "令狐", "端木", "南宫")

SPELLED = re.compile(rf"(?<!\w)(?:{DIGIT_WORDS})(?:[ ,-]{{1,2}}(?:{DIGIT_WORDS})){{6,14}}(?!\w)", re.I)
NUMBER = re.compile(r"(?<![\w.])(?:[+＋] ?|[(（](?=\d{1,5}[)）]))?\d(?:[ .()（）\-－–/]{0,3}\d){6,21}(?:(?<=\d{17})[Xx](?!\w))?(?![\d]|[.\-]?\d)(?: ?(?:ext|extn|x|durchwahl|分机)\.? ?\d{1,5})?", re.I)
LETTERED = re.compile(r"(?<![\w-])(?:ID ?\d{7,12}|[A-Z]{1,2}\d{7,9}[A-Z]?|\d{7,8}-?[A-Z]|[A-Z]\d{2} ?\d{6} ?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]-\d{4}\.\d{3}/[A-Z]|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\w-])", re.I)
ENGLISH_ADDRESS = re.compile(rf"(?<![\w.])(?:(?:flat|apt\.?|apartment|unit|suite) \d{{1,4}}[a-z]?, ?)?\d{{1,5}} ?[a-z]? (?:(?:[^\W\d_][\w'’-]+) ){{1,3}}?(?:(?:{STREETS})\b|(?:{STREETS_CUT})\b\.?)(?-i:, [A-Z][\w-]+(?: [A-Z]+\d[\w]*| \d{{4,6}})?)?", re.I)
HAN_ADDRESS = re.compile(r"[一-鿿]{1,8}?(?:大道|胡同|[路街巷弄道])\d{1,5}(?:号|號)(?:\d{1,4}(?:室|楼|单元|栋))*")
HAN = re.compile(r"[一-鿿]+")
_WORD = "[^\\W\\d_一-鿿]"
_CAP = rf"[^\W\d_a-zß-öø-ÿ一-鿿]{_WORD}+(?:['’-]{_WORD}+)*"
_FULL = re.compile(rf"(?:(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra)\.? )?((?:{_CAP}|[^\W\d_]\.)(?: [^\W\d_]\.)?(?: |, ){_CAP})(?![\w@＠-])")
_BACK = re.compile(rf"(?<!\w)((?:{_CAP}|[^\W\d_]\.)(?: [^\W\d_]\.)?(?: |, ){_CAP})[ ,]*\Z")
_SMALL = re.compile(rf"({_WORD}{{3,}}(?: {_WORD}\.)?(?: |, ){_WORD}{{3,}})(?=\Z|[;/|).,!?\n\"\0]| \|| [^\W\d_a-zß-öø-ÿ]|{'|'.join(f' {x}' for x in (*PERSON_VERBS, *DEPARTMENTS, 'before the', 'after the'))})")
_LONE = re.compile(rf"(?:[;/|(∙] ?|\bre: ?|\bfwd |-- )((?:{_CAP}|[^\W\d_]\.)(?: [^\W\d_]\.)? {_CAP})(?= ?[;/|).!,?\"\0\n]|\Z)|, ([^\W\d_]\. {_CAP})(?= ?[;/|).!,?\"\0\n]|\Z)")
_SMALL_BACK = re.compile(rf"(?:\A|[;/|(.!?\n\"\0∙] ?|, )({_WORD}{{3,}}(?: {_WORD}\.)? {_WORD}{{3,}}) \Z")
_TOLD = re.compile(rf"(?:{'|'.join(map(re.escape, NAME_BEFORE))})[\\s:：=>-]{{1,4}}\\Z")
_GLUE = re.compile(r"""[\s:：=>"'\-–—*]{0,6}""")
_LOCAL = re.compile(r"([\w.+\-]*[\w+\-])(?:%20| )?\Z")
_DOMAIN = re.compile(r"(?:%20| )?([\w-]+(?:(?:(?: |%20)?[\(\[{] ?dot ?[\)\]}](?: |%20)?| dot |[.．])[\w-]+)*(?:(?: |%20)?[\(\[{] ?dot ?[\)\]}](?: |%20)?| dot |[.．])([^\W\d_]{2,24}))(?![\w-])", re.I)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_ENDS = re.compile(r"""[\s"'(（]*\Z""")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """IBAN rule: the first four characters move to the end, letters count from 10."""
    moved = text[4:] + text[:4]
    return moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def mod11(text: str) -> bool:
    """The last character of an 18-place resident number."""
    return len(text) == 18 and text[:17].isdigit() and "10X98765432"[sum(int(c) * pow(2, 17 - k, 11) for k, c in enumerate(text[:17])) % 11] == text[17].upper()


def mod23(text: str) -> bool:
    """The letter after a number of seven or eight digits."""
    return text[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(text[:-1]) % 23] == text[-1].upper()


def key97(digits: str) -> bool:
    """A number of 11 or 15 digits whose last two are 97 less the rest modulo 97."""
    return len(digits) in (11, 15) and int(digits[-2:]) == 97 - int(digits[:-2]) % 97


def unescape(raw: str) -> tuple[str, list[int] | None]:
    """The text with JSON escapes read, and the place in ``raw`` of each of its characters (and of the end); None if equal."""
    if "\\" not in raw:
        return raw, None
    out: list[str] = []
    at: list[int] = []
    done = 0
    for m in _ESCAPE.finditer(raw):
        a = m.start()
        out.append(raw[done:a])
        at.extend(range(done, a))
        if m[1]:
            c = chr(int(m[1], 16))
            if "\udc00" <= c <= "\udfff" and out[-1] == "" and len(out) > 1 and "\ud800" <= out[-2] <= "\udbff":
                out[-2] = chr(0x10000 + (ord(out[-2]) - 0xD800) * 0x400 + ord(c) - 0xDC00)
                done = m.end()
                continue
            out.append(c)
        else:
            out.append(_SHORT.get(m[2], m[2]))
        at.append(a)
        done = m.end()
    out.append(raw[done:])
    at.extend(range(done, len(raw) + 1))
    text = "".join(out)
    if len(text) + 1 != len(at):  # cannot be, but a wrong place would damage the text
        return raw, None
    return text, at


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(names: dict[str, str]) -> object:
    """Anchors by kind; ``names``: lower-case word to given or family."""
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list[str]] = {}
    for words, kind in ((names, "name"), (NAME_BEFORE, "before"), (NAME_FIELDS, "field"), (ROLES, "role"), (REQUESTS, "role"), (PERSON_VERBS, "after"), (DEPARTMENTS, "after"), (TITLES, "before"), (GERMAN_STREETS, "german"), (SPANISH_STREETS, "spanish"), (("@", "＠", "%40", "&#64;", "&#x40;", "&commat;", "[at]", "(at)", "{at}", "[ at ]", "( at )", " at "), "at")):
        for w in words:
            entries.setdefault(w, []).append(kind)
    for w, kinds in entries.items():
        a.add_word(w, (w, tuple(kinds)))
    a.make_automaton()
    return a


def _context(left: str, words: tuple[str, ...]) -> bool:
    return any(re.search(rf"(?<![^\W\d_]){re.escape(w)}", left) for w in words if w in left)


_OTHER = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(OTHER_NUMBERS)})s?(?:[ _-]?(?:number|no|nr|num|id|号))?\.?[\s:：#=\-\"'>]{{0,5}}\Z")


def _number(text: str, a: int, b: int, lettered: bool) -> str | None:
    """ID_NUMBER, PHONE or None, by shape, checksum and context."""
    s = text[a:b]
    left = lowered(text[max(0, a - 36) : a])
    left = re.sub(r"\b(no|nr|núm|num)\. ", r"\1 ", left)  # these dots end no sentence
    for stop in ("; ", "\n", ". ", " | ", ", ", '","'):
        left = left.rpartition(stop)[2] if not left.endswith(stop) else ""
    if _OTHER.search(left):
        return None
    as_id, as_phone = _context(left, ID_WORDS), _context(left, PHONE_WORDS)
    as_number = not as_id and _context(left, NUMBER_WORDS)
    core = re.sub(r"(?: ?(?:ext|extn|x|durchwahl|分机)\.? ?\d{1,5})\Z", "", s, flags=re.I)
    digits = "".join(str(int(c)) for c in core if c.isdigit())
    # what a checksum says: +1 holds, -1 fails, 0 there is none for the shape
    says = lambda holds: 1 if holds else -1
    if lettered:
        letters = sum(c.isalpha() for c in core)
        bare = re.sub(r"[^A-Za-z0-9]", "", core)
        if len(bare) >= 15 and letters >= 2:  # an account number, unless it is none and stands where an identity number should
            return "ID_NUMBER" if as_id and not mod97(bare.upper()) else None
        score, check = 1.0, 0
        if re.fullmatch(r"\d{7,8}-?[A-Za-z]", core):
            score, check = 0.5, says(mod23(bare))
        elif re.fullmatch(r"[A-Za-z]{1,2}\d{7,9}", core):
            score, check = 0.7, says(luhn(digits))
        score += 0.9 * as_id + 0.3 * as_number + (0.5 if check > 0 else 0.3 * check) - 0.4 * (core.upper() != core)
        return "ID_NUMBER" if score >= 1 else None
    digits += core[-1] if core[-1] in "xX" else ""
    n, groups = len(digits), [len(g) for g in re.findall(r"\d+", core)]
    plus = s[0] in "+＋"
    if not plus and re.match(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?(?:\D|\Z)", core):
        return None
    shape, check = 0.2 if 6 <= n <= 18 else 0.0, 0
    if n == 18 and len(groups) == 1:
        shape, check = 0.5, says(mod11(digits))
    elif groups == [2, 3, 3, 3] and not plus:
        shape, check = 0.5, says(luhn(digits) or key97(digits))
    elif groups == [3, 2, 4] and not plus and "(" not in core:
        shape = 1.0  # has no checksum
    elif n in (11, 15) and len(groups) == 1 and not plus:
        shape, check = 0.4, says(key97(digits))
    elif n in (9, 10, 13) and len(groups) == 1 and not plus:
        shape, check = 0.3, says(luhn(digits))
    id_score = shape + 0.9 * as_id + 0.3 * as_number + (0.5 if check > 0 else 0.3 * check) - 0.9 * as_phone
    phone_score = 0.9 * as_phone - 0.9 * as_id
    single = len(groups) >= 7 and sum(g == 1 for g in groups) >= len(groups) - 1
    if plus and 8 <= n <= 15 or core[0] in "(（" and 7 <= n <= 13:
        phone_score += 1.0
    elif digits.startswith("00") and groups[0] in (4, 5) and 10 <= n <= 15:
        phone_score += 1.0
    elif single or groups in ([3, 4, 4], [3, 3, 4], [4, 3, 4]) or digits[0] == "0" and len(groups) >= 2 and groups[0] in (3, 4, 5) and 9 <= n <= 12:
        phone_score += 1.0
    elif b - a > len(core) and n >= 6:
        phone_score += 1.0
    elif 7 <= n <= 15:
        phone_score += 0.2
    if max(id_score, phone_score) < 1:
        return None
    return "ID_NUMBER" if id_score >= phone_score else "PHONE"


def find(text: str, auto: object, names: dict[str, str]) -> list[Span]:
    """Spans of a text in which NUL parts documents; no span crosses one. Overlaps are resolved by the order of TYPES."""
    low = lowered(text)
    found: list[Span] = []
    hits: list[tuple[int, int, str]] = []
    for last, (word, kinds) in auto.iter(low):
        end = last + 1
        start = end - len(word)
        for kind in kinds:
            if kind == "at":
                if word == " at " and " dot " not in low[end : end + 48]:
                    continue
                left = text[max(0, start - 80) : start].rpartition("\0")[2]
                m, d = _LOCAL.search(left), _DOMAIN.match(text, end, end + 120)
                if m and d and not (word == " at " and " dot " not in d[0].lower()):
                    found.append(Span(start - (len(left) - m.start(1)), d.end(), "EMAIL"))
            elif kind == "name":
                if (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and not (text[end : end + 1].isalnum() or text[end : end + 1] == "_"):
                    hits.append((start, end, names[word]))
            elif kind in ("before", "field"):
                if start and text[start - 1].isalpha() and word[0].isascii() and not text[start - 1] > "⹿":
                    continue
                g = _GLUE.match(text, end)
                if kind == "field" and not re.search("[:：=>]", g[0]):
                    continue
                if word[-1].isalpha() and word[-1].isascii() and g.end() == end and word != "herr " and word != "frau ":
                    continue
                m = _FULL.match(text, g.end()) or (_SMALL.match(text, g.end()) if word not in TITLES else None)
                if m and not {w.strip(",.").lower() for w in m[1].split()} & NOT_NAMES and "\0" not in m[1]:
                    found.append(Span(*m.span(1), "NAME"))
                elif h := HAN.match(text, g.end()):
                    if len(h[0]) <= 5:
                        if len(h[0]) >= 2:
                            found.append(Span(*h.span(), "NAME"))
                    elif h[0][:2] in DOUBLE_SURNAMES:
                        found.append(Span(h.start(), h.start() + 4, "NAME"))
                    elif h[0][0] in SURNAMES:
                        found.append(Span(h.start(), h.start() + 3, "NAME"))
            elif kind == "role":  # a weak cue: a name in capitals right after it
                if (start and text[start - 1].isalnum()) or text[end : end + 1] != " ":
                    continue
                m = _FULL.match(text, end + 1) or _SMALL.match(text, end + 1)
                if m and _likely(m[1], names):
                    found.append(Span(*m.span(1), "NAME"))
                elif (h := HAN.match(text, end + 1)) and (2 <= len(h[0]) <= 4 and h[0][0] in SURNAMES or 3 <= len(h[0]) <= 5 and h[0][:2] in DOUBLE_SURNAMES):
                    found.append(Span(*h.span(), "NAME"))
            elif kind == "after":
                if text[end : end + 1].isalnum() or not start or text[start - 1].isalnum():
                    continue
                left = text[max(0, start - 60) : start].rpartition("\0")[2]
                m = _BACK.search(left)
                if m and _likely(m[1], names):
                    found.append(Span(start - len(left) + m.start(1), start - len(left) + m.end(1), "NAME"))
                elif (m := _SMALL_BACK.search(left)) and _likely(m[1], names):
                    found.append(Span(start - len(left) + m.start(1), start - len(left) + m.end(1), "NAME"))
                elif h := re.search(r"([一-鿿]{2,5})[ ,]*\Z", left):
                    found.append(Span(start - len(left) + h.start(1), start - len(left) + h.end(1), "NAME"))
            elif kind == "german":
                m = re.compile(r" ?\d{1,4} ?[A-Za-z]?(?![\w.])(?:, ?\d{4,5} [A-ZÄÖÜ][\w-]+)?").match(text, end)
                if m and (start == 0 or text[start - 1].isalpha() or word[:3] == "str"):
                    a = start
                    while a and (text[a - 1].isalpha() or text[a - 1] == "-" and text[a - 2].isalpha()) and not text[a - 1] > "⹿":
                        a -= 1
                    if a == start:  # a word of its own: with the capitalised word before it
                        w = re.search(r"[A-ZÄÖÜ][\w-]+ \Z", text[max(0, a - 30) : a])
                        if not w:
                            continue
                        a -= len(w[0])
                    elif not text[a].isupper() and end - a < len(word) + 4:
                        continue
                    found.append(Span(a, m.end(), "ADDRESS"))
            elif kind == "spanish" and (start == 0 or not text[start - 1].isalnum()):
                m = re.compile(r"\.? (?:de(?: la| los| las|l)? )?[^\W\d_][\w'-]+(?: [^\W\d_][\w'-]+)?,? (?:n[ºo°]?\.? ?)?\d{1,4} ?[A-Za-z]?(?!\w)(?:, ?\d{4,5} [A-Z][\w-]+)?").match(text, end)
                if m:
                    found.append(Span(start, m.end(), "ADDRESS"))
    for m in ENGLISH_ADDRESS.finditer(text):
        words = m[0].split()
        if "\0" not in m[0] and not any(w.lower().strip(",.") in NOT_NAMES for w in words[1:]):
            street = [w for w in words if w[:1].isalpha()]
            if any(w[0].isupper() for w in street) or re.search(rf"\d+ ?[a-z]? [^\W\d_][\w'-]{{5,}} (?:street|road|avenue|lane|terrace|way|close|drive|court|st|rd|ln|ave)\b", m[0]):
                found.append(Span(*m.span(), "ADDRESS"))
    found += (Span(*m.span(), "ADDRESS") for m in HAN_ADDRESS.finditer(text))
    found += (Span(*m.span(), "PHONE") for m in SPELLED.finditer(text))
    for pattern, lettered in ((NUMBER, False), (LETTERED, True)):
        for m in pattern.finditer(text):
            kind = _number(text, *m.span(), lettered)
            if kind:
                found.append(Span(*m.span(), kind))
    _names(text, hits, found)
    for m in _LONE.finditer(text):
        k = 1 if m[1] else 2
        said = [w.strip(".") for w in m[k].split()]
        if not m[k].isupper() and all(w[0].isupper() and (len(w) == 1 or not w.isupper()) for w in said) and not {w.lower() for w in said} & NOT_NAMES:
            found.append(Span(*m.span(k), "NAME"))
    for m in HAN.finditer(text):
        run = m[0]
        if 3 <= len(run) <= 5 and (run[:2] in DOUBLE_SURNAMES and len(run) >= 4 or run[0] in SURNAMES and len(run) <= 4) and _alone(text, *m.span()):
            found.append(Span(*m.span(), "NAME"))
    return _resolve(found)


def _likely(said: str, names: dict[str, str]) -> bool:
    """Whether two words beside a weak cue are a name: capitalised, or in one case throughout with a known name word."""
    words = [w.strip(",.").lower() for w in said.split()]
    if set(words) & NOT_NAMES or "\0" in said:
        return False
    return (all(w[0].isupper() for w in said.split()) and not said.isupper()) or any(w in names for w in words)


def _alone(text: str, a: int, b: int) -> bool:
    """Whether the span stands by itself between marks, as a note or list item does."""
    left, right = text[max(0, a - 5) : a], text[b : b + 2]
    return bool(re.search(r"""(?:^|[;/|(:：=>\n"∙\0-]|\bfwd) ?\Z""", left)) and bool(re.match(r"""\Z|[;/|).,!?\n"\0]| [;/|]""", right))


def _names(text: str, hits: list[tuple[int, int, str]], found: list[Span]) -> None:
    k = 0
    while k < len(hits):
        a, b, use = hits[k]
        if k + 1 < len(hits):
            c, d, other = hits[k + 1]
            between = text[b:c]
            if c - b <= 5 and use != other and (re.fullmatch(r" (?:[^\W\d_]\.? )?|[  ]", between) or between in (", ", ",") and use == "family") and text[d : d + 1] != "@":
                found.append(Span(a, d, "NAME"))
                k += 2
                continue
        k += 1
        word, before, after = text[a:b], text[max(0, a - 40) : a].rpartition("\0")[2], text[b : b + 40].partition("\0")[0]
        if re.match(r"[-_@＠.]\w", after) or before[-1:] in "@＠+-_.%" and before:
            continue
        if use == "family" and (m := re.search(r"(?<!\w)[^\W\d_]\. ?(?:[^\W\d_]\. ?)?\Z", before)) and m[0][0].isupper():
            found.append(Span(a - len(m[0]), b, "NAME"))
            found.append(Span(a - len(m[0]) + m[0].rstrip().rfind(" ") + 1, b, "NAME"))  # with one initial, should the first belong to something else
            continue
        if use == "family" and (m := re.match(r", [^\W\d_]\.(?!\w)", after)) and m[0][2].isupper():
            found.append(Span(a, b + len(m[0]), "NAME"))
            continue
        if use == "given":
            m = re.match(r" (?:[^\W\d_]\. )?([^\W\d_]+(?:['’-][^\W\d_]+)*)(?![\w@＠])", after)
            x = (a, b + m.end(), m[1]) if m else None
            if not x and (m := re.search(r"(?<![\w@-])([^\W\d_]{2,}), \Z", before)) and m[1][0].isupper() and not word.isupper() and m[1].lower() not in NOT_NAMES and not re.match(r" [a-z]+ is ", after):
                found.append(Span(a - len(m[0]), b, "NAME"))
                continue
        else:
            m = re.search(r"(?<![\w@-])([^\W\d_]{2,}(?:['’-][^\W\d_]+)*) (?:[^\W\d_]\. )?\Z", before)
            x = (a - len(m[0]), b, m[1]) if m else None
            if not x and (m := re.match(r", ([^\W\d_]{2,})(?![\w@])", after)) and m[1][0].isupper() and _alone(text, a, b + m.end()):
                x = (a, b + m.end(), m[1])
        if not x or x[2].lower() in NOT_NAMES:
            continue
        like = x[2][0].isupper() and not x[2].isupper() and word[0].isupper() and not word.isupper()
        told = before if use == "given" else text[max(0, x[0] - 24) : x[0]].rpartition("\0")[2]
        if like or _TOLD.search(lowered(told)) or _alone(text, x[0], x[1]) and x[2].isupper() == word.isupper():
            found.append(Span(x[0], x[1], "NAME"))


def _resolve(found: list[Span]) -> list[Span]:
    rank = {t: k for k, t in enumerate(TYPES)}
    kept: list[Span] = []
    starts: list[int] = []
    for s in sorted(set(found), key=lambda s: (rank[s.kind], s.start - s.end, s.start)):
        at = bisect_right(starts, s.start)
        if (at and kept[at - 1].end > s.start) or (at < len(kept) and kept[at].start < s.end):
            continue
        kept.insert(at, s)
        starts.insert(at, s.start)
    return kept


def scan(texts: list[str | None], auto: object, names: dict[str, str]) -> list[list[Span]]:
    """The spans of each text, in places of the text as given; a null or empty text has none."""
    decoded = [unescape(t.replace("\0", " ")) if t else ("", None) for t in texts]
    starts, at = [], 0
    for d, _ in decoded:
        starts.append(at)
        at += len(d) + 1
    out: list[list[Span]] = [[] for _ in texts]
    for s in find("\0".join(d for d, _ in decoded), auto, names):
        k = bisect_right(starts, s.start) - 1
        a, b, places = s.start - starts[k], s.end - starts[k], decoded[k][1]
        out[k].append(s if places is None and not starts[k] else Span(*((a, b) if places is None else (places[a], places[b])), s.kind))
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with ``[TYPE]`` in place of each span, all else unchanged."""
    out, done = [], 0
    for s in spans:
        out += (text[done : s.start], f"[{s.kind}]")
        done = s.end
    return "".join([*out, text[done:]])


def _runner(names: dict[str, str], masked: bool, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(names)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                texts = batch.column(2).to_pylist()
                spans = scan(texts, auto, names)
                keep = [k for k, s in enumerate(spans) if s]
                cols = [batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array([sorted({s.kind for s in spans[k]}) for k in keep], pa.list_(pa.string()))]
                if masked:
                    cols.append(pa.array([mask(texts[k], spans[k]) for k in keep], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["table_name", "record_id", "pii_types", "masked"][: len(cols)])

    return run


def name_words(tokens: DataFrame, most: int = 200_000) -> dict[str, str]:
    """The name words, lower-case, with their use; a word of both uses counts as given. More than ``most`` are an error, as they go to every worker."""
    distinct = tokens.select(F.lower("name_token").alias("word"), "token_use").where(F.col("word") != "").distinct()
    if (n := distinct.count()) > most:
        raise ValueError(f"{n} name words, more than {most}")
    rows = distinct.collect()
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: (r[1] or "", r[0]))} | {r[0]: "given" for r in rows if r[1] == "given"}


def personal_data(records: DataFrame, tokens: DataFrame, masked: bool = True, chunk: int = 512) -> DataFrame:
    """Of rows (table_name, record_id, text), those with personal data: their types, and the masked text.

    A null or empty text has none. Copies come out as often as they stand. Whole texts are read, whatever their length.
    """
    schema = "table_name string, record_id string, pii_types array<string>" + ", masked string" * masked
    return records.select("table_name", "record_id", "text").mapInArrow(_runner(name_words(tokens), masked, chunk), schema)


def personal_types(records: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct rows (table_name, record_id, pii_type)."""
    return personal_data(records, tokens, masked=False).select("table_name", "record_id", F.explode("pii_types").alias("pii_type")).distinct()
