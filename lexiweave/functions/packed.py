r"""A parsing expression grammar for several values packed into one text.

    answer <- preface* label? body
    body   <- '[' list ']' / list
    list   <- slot (separator slot)*
    slot   <- mark? (quoted / bracketed / bare)
    quoted <- quote ('quote quote' / !quote .)* quote &after_value      tried first; a quote that is
                                                                       never closed is read as bare
    bare   <- (!separator !next_number !joiner .)*
    joiner <- ' and ' &(slot '.'? end)

Alternatives are tried in order and the first that matches wins, so a text has one reading at most.
What an alternative needs to know of the text ahead (the next closing quote, whether a separator is
still to come) is found once for the whole text and looked up from then on, so that going back costs
nothing: the time grows with the length of the text, whatever is in it.

The functions here look at one text and know nothing of tables.
"""

import re
from bisect import bisect_left
from dataclasses import dataclass, field

#: What may part two values (a middle dot only before a blank), the joining word, and numbers of a list.
_STOP = re.compile(r"\|\||[,;|/、，；\t\n]|·(?=\s|$)|(?<=[ \xa0])and(?=[ \xa0])|(?<=\s)\(?\d{1,3}[.)](?=\s)")
_SEPARATOR = re.compile(r"\|\||[,;|/、，；\t\n]|·(?=\s|$)")
_MARK = re.compile(r"[-•*–]\s+|[-•](?=\w)")
_NUMBER = re.compile(r"\((\d{1,3})\)\s*|(\d{1,3})[.)]\s+")
_SPACES = re.compile(r"[\s\xa0]*")
_AFTER_SPACES = re.compile(r"\|\||[,;|/、，；·\])}]|\.?[\s\xa0]*$|\((?:\d{1,3})\)|\d{1,3}[.)]\s")
_LAST = re.compile(r"[\s\xa0,;|/、·]*\.?[\s\xa0]*$")
_AND_HERE = re.compile(r"and[ \xa0]+(?=\S)")
_LABEL = re.compile(r"(?:^|\n)[ \t]*(?:output|answer|response)[ \t]*:[ \t]*", re.I)
_ANY_LABEL = re.compile(r"[ \t]*[^\s,;:|/.!?\"'\[\]()]+(?: [^\s,;:|/.!?\"'\[\]()]+)?[ \t]*:\s*")
_ECHO = re.compile(r"(?:^|\n)[ \t]*(?:input(?: word)?|candidates|words|list)[ \t]*:", re.I)
_LIST_NAMED = re.compile(r"candidates|list|words", re.I)
_WORD = re.compile(r"\w")
_QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "„": "“", "‘": "’"}
_BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
#: A value that begins with none of these is bare and has no mark.
_SPECIAL = frozenset([*_QUOTES, *_BRACKETS, *"-•*–0123456789"])
#: A number of a list behind something else than a separator.
_INNER_NUMBER = re.compile(r"[^\s,;|/、，；·][ \xa0]+\(?\d{1,3}[.)]\s")
_BLANK_AND = re.compile(r"[ \xa0]and[ \xa0]")


@dataclass(slots=True)
class Packed:
    """How a text reads. errors: unclosed_quote, unclosed_bracket, empty_slot."""

    values: list[str] = field(default_factory=list)
    bare: list[bool] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    closed: bool = False
    open_end: bool = False  # ends with a separator
    label: str = ""
    echo: bool = False  # repeats the question or the list it was given
    preface: str = ""


class _Text:
    """A text, and the places of its signs, each kind found once when it is first asked for."""

    def __init__(self, t: str) -> None:
        self.t = t
        self.stops = list(_STOP.finditer(t))
        self.at = [m.start() for m in self.stops]
        self.end = len(t.rstrip(" \t\n\xa0,;|/、·"))  # without separators that nothing follows
        self.last_part = max((m.start() for m in self.stops if not m[0][0].isdigit() and m[0][0] != "(" and (m[0] == "and" or m.start() < self.end)), default=-1)
        self.separators = [m.start() for m in self.stops if m[0] != "and" and not m[0][0].isdigit() and m[0][0] != "("]
        self.closings: dict[str, tuple[list[int], list[int]]] = {}
        self.places: dict[str, list[int]] = {}

    def next_place(self, sign: str, p: int) -> int:
        """The first place of a sign from p on, or the end of the text."""
        places = self.places.get(sign)
        if places is None:
            places = self.places[sign] = [m.start() for m in re.finditer(re.escape(sign), self.t)]
        k = bisect_left(places, p)
        return places[k] if k < len(places) else len(self.t)

    def after_value(self, p: int) -> bool:
        """True where a quoted value may end: at a separator, a joiner, the next number, a bracket or the end."""
        q = _SPACES.match(self.t, p).end()
        if _AFTER_SPACES.match(self.t, q):
            c = self.t[q : q + 1]
            return not (c.isdigit() or c == "(") or q > p
        gap = self.t[p:q]
        return "\n" in gap or "\t" in gap or (q > p and _AND_HERE.match(self.t, q) is not None)

    def quoted(self, p: int) -> tuple[str, int] | None:
        """The quoted value at p and where it ends. A doubled quote stands for one; a value doesn't go over a line end."""
        t = self.t
        close = _QUOTES.get(t[p : p + 1])
        if close is None:
            return None
        if close not in self.closings:  # signs in a row are pairs, so only rows of odd length can close
            runs = [m.span() for m in re.finditer(re.escape(close) + "+", t)]
            runs = [(a, b) for a, b in runs if (b - a) % 2 and self.after_value(b)]
            self.closings[close] = [a for a, _ in runs], [b for _, b in runs]
        starts, ends = self.closings[close]
        q = p + 1
        while t[q : q + 1] == close:
            q += 1
        first = q - p - 1  # signs right behind the opening one
        if first % 2 and first > 1 and self.after_value(q):
            end = q
        else:
            k = bisect_left(starts, max(q, p + 1))
            if k == len(starts):
                return None
            end = ends[k]
        if self.next_place("\n", p) < end:
            return None
        return t[p + 1 : end - 1].replace(close * 2, close), end

    def bracketed(self, p: int) -> tuple[str, int] | None:
        t = self.t
        close = _BRACKETS.get(t[p : p + 1])
        if close is None:
            return None
        q = self.next_place(close, p + 1)
        k = bisect_left(self.separators, p + 1)
        if q == len(t) or (k < len(self.separators) and self.separators[k] < q) or not self.after_value(q + 1):
            return None
        value = t[p + 1 : q].strip()
        return (value, q + 1) if value else None

    def ends_after_one_slot(self, p: int) -> bool:
        p = _SPACES.match(self.t, p).end()
        if q := self.quoted(p):
            return bool(_LAST.match(self.t, q[1]))
        return p < self.end and self.last_part < p


def _plain_list(t: str, out: Packed) -> bool:
    """Reads a list whose separators all part values: bare ones, and quoted ones that hold no separator. False, and nothing read, for any other text."""
    values, bare, numbered = [], [], 0
    for v in _SEPARATOR.split(t):
        v = v.strip()
        c = v[:1]
        if c not in _SPECIAL:
            values.append(v)
            bare.append(True)
            continue
        if c in "-•*–" and (m := _MARK.match(v)):
            v = v[m.end() :]
            c = v[:1]
        if c.isdigit() or c == "(":
            m = _NUMBER.match(v)
            if not m or int(m[1] or m[2]) != numbered + 1:
                return False
            numbered, v = numbered + 1, v[m.end() :]
            c = v[:1]
        quoted = c in _QUOTES
        if quoted:
            close = _QUOTES[c]
            if len(v) < 3 or v[-1] != close or close in v[1:-1] or v[1:-1].isspace():
                return False
            v = v[1:-1]
        elif c in _SPECIAL:
            return False
        values.append(v)
        bare.append(not quoted)
    if _BLANK_AND.search(t) or (numbered and _INNER_NUMBER.search(t)):
        return False
    out.open_end = len(values) > 1 and not values[-1]
    if out.open_end:
        values.pop()
        bare.pop()
    if "" in values:
        # A line end or tab beside another separator is layout and no empty slot.
        waiting = False
        for v, m in zip(values, _SEPARATOR.finditer(t)):
            sign = m[0] not in "\t\n"
            if not v and sign and waiting:
                out.errors.append("empty_slot")
            waiting = sign or (waiting and not v)
        bare = [b for v, b in zip(values, bare) if v]
        values = [v for v in values if v]
    out.values += values
    out.bare += bare
    return True


def _list(t: str, out: Packed, joined: bool) -> None:
    text = _Text(t)
    stops, at, n = text.stops, text.at, len(t)
    p = _SPACES.match(t, 0).end()
    numbered, white = 0, True
    while p < n:
        if m := _MARK.match(t, p):
            p = m.end()
        if (m := _NUMBER.match(t, p)) and int(m[1] or m[2]) == numbered + 1:
            numbered, p = numbered + 1, m.end()
        if joined and t.startswith("and", p) and (m := _AND_HERE.match(t, p)) and text.ends_after_one_slot(m.end()):
            p = m.end()
        opened = t[p : p + 1]
        k = bisect_left(at, p)
        if got := text.quoted(p) or text.bracketed(p):
            value, p = got
            bare = False
            k = bisect_left(at, p)
            here = k < len(at) and _SPACES.match(t, p).end() >= at[k]
        else:
            while k < len(stops):
                sign = stops[k][0]
                if sign == "and":
                    if text.ends_after_one_slot(stops[k].end()):
                        break
                elif sign[0].isdigit() or sign[0] == "(":
                    if numbered and int(sign.strip("().")) == numbered + 1:
                        break
                else:
                    break
                k += 1
            here = k < len(stops)
            end = at[k] if here else n
            value, p, bare = t[p:end].strip(), end, True
            if value[:1] in ('"', "“", "«") or (value[:1] == "'" and value.count("'") % 2):
                out.errors.append("unclosed_quote")
                value = value[1:].strip()
            elif opened in ("[", "{"):
                out.errors.append("unclosed_bracket")
                value = value[1:].strip()
        if value:
            out.values.append(value)
            out.bare.append(bare)
        elif p < n and not white:
            out.errors.append("empty_slot")
        out.open_end, white = False, False
        if here:
            sign = stops[k][0]
            if sign[0].isdigit() or sign[0] == "(":
                p = at[k]
            else:
                out.open_end, white = sign != "and", sign in "\t\n"
                p = _SPACES.match(t, stops[k].end()).end()
        elif p < n:
            q = _SPACES.match(t, p).end()
            if q == p:
                out.errors.append("unclosed_quote")  # text right behind a quoted value: malformed, goes on as its own value
                if not value:  # never stand still
                    q = p + 1
            p = q


def unpack(text: str | None, cue: str | None = None, *, answer: bool = True) -> Packed:
    """Read a packed text. With answer, prefaces, labels, the repeated question, the joining word and the closing period go.

    Null and blank texts have no values. Every character is looked at, however long the text is.
    """
    out = Packed()
    t = (text or "").strip()
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if answer and t:
        first = t.find("\n")
        own = cue.strip().lower() if cue else ""
        if ":" in t:
            labels = list(_LABEL.finditer(t))
            out.echo = bool(_ECHO.search(t))
        else:
            labels = []
        if labels:
            m = labels[-1]
            out.preface, out.label, t = t[: m.start()].strip(), "output", t[m.end() :]
        elif own and t[: len(own)].lower() == own and t[len(own) :].lstrip()[:1] == ":":
            out.label, t = "cue", t[len(own) :].lstrip()[1:]
        elif out.echo:
            out.preface, t = "", _ECHO.split(t)[-1] if _LIST_NAMED.search(t) else ""
        elif ":" in t and (m := _ANY_LABEL.match(t)):
            out.label, t = "other", t[m.end() :]
        elif first > 0 and t[:first].rstrip()[-1:] in (":", "!", ".") and not any(c in t[:first] for c in ",;|") and not _MARK.match(t) and not _NUMBER.match(t):
            out.preface, t = t[:first].strip(), t[first + 1 :]
    t = t.strip()
    if answer and t.endswith(".") and t.strip(". "):
        out.closed, t = True, t[:-1].rstrip()
    if len(t) > 1 and t[0] == "[" and t[-1] == "]":
        t, out.closed = t[1:-1].strip(), True
    elif t[:1] == "[" and "]" not in t:
        out.errors.append("unclosed_bracket")
        t = t[1:]
    if answer and not _WORD.search(t):
        out.open_end = bool(t)
        return out
    if t and not _plain_list(t, out):
        _list(t, out, answer)
    if not all(map(_WORD.search, out.values)):
        keep = [bool(_WORD.search(v)) for v in out.values]
        out.values, out.bare = [v for v, k in zip(out.values, keep) if k], [b for b, k in zip(out.bare, keep) if k]
    return out


#: Words that only a sentence holds, not an association.
_SENTENCE = frozenset("i i'm i've i'd you your this that these not to with for the is am are was be been being my me of such it its it's they has have had will won't would can can't cannot don't does do on at by as so and when here there which whose what".split())
_STOPPED = re.compile(r"[!?.]\s|[!?]$")


def folded(text: str) -> str:
    """Only the letters and digits of a text, in lower case."""
    low = text.lower()
    return low if low.isalnum() else "".join(c for c in low if c.isalnum())


def is_prose(value: str, bare: bool) -> bool:
    """True for a value that is (part of) a sentence: over three words, a stop within it, or words that lists don't hold."""
    if not bare or (value.isalpha() and value.isascii()):
        return False
    words = value.lower().replace("’", "'").split()
    return len(words) > 3 or bool(_STOPPED.search(value)) or (len(words) > 1 and any(w.strip(".,!?") in _SENTENCE for w in words))


#: What list_reading says.
NO_LIST, A_LIST, LIST_IF_KNOWN = 0, 1, 2


def list_reading(got: Packed, cue: str | None, candidates: list[str] | None, asked: int) -> int:
    """Whether an answer reads as the list it was asked for: NO_LIST, A_LIST, or LIST_IF_KNOWN (a list, if one of its words is in use).

    No list is an answer without values, one that repeats the question, the cue alone or the whole list
    of candidates (the folded words it was to choose from), one with a sentence among its values, and
    one that breaks off: it has fewer values than were asked for and no closing period, or its last
    value is only the beginning of a candidate. A list of words that are not among the candidates is
    none; where there are no candidates its words decide.
    """
    values = [folded(v) for v in got.values]
    if not values or (got.echo and got.label != "output"):
        return NO_LIST
    prose = any(map(is_prose, got.values, got.bare))
    if asked == 2 and len(values) > 2 * asked and (not prose if not candidates else 10 * len(set(values) & set(candidates)) >= 8 * len(set(values))):
        return NO_LIST
    own = folded(cue or "")
    if prose or (own and set(values) == {own} and (len(values) > 1 or not got.open_end)):
        return NO_LIST
    if len(values) < asked and not got.closed:
        return NO_LIST
    if not candidates:
        return LIST_IF_KNOWN
    chosen = set(values) & {*candidates, own}
    if not chosen and not any(c.startswith(values[0]) for c in candidates):
        return NO_LIST
    cut = len(values) == asked and not got.closed and not got.open_end and values[-1] not in candidates and any(c.startswith(values[-1]) for c in candidates)
    return NO_LIST if cut else A_LIST
