"""Training pairs for problem 6: sound and defective answers made from clean ones, each kind by several families of wordings.

The wordings are put together from parts, so that a classifier has to learn what sentences of a kind
have in common. No wording is taken from data. A family is one way of saying something; calibration
holds out whole families.
"""

import random
import re
from collections.abc import Callable, Sequence

DEFECTS = ("empty", "truncated", "refusal", "copy", "language")

_TALK = ("touch on {cue}", "go into {cue}", "say anything on {cue}", "come up with anything for {cue}", "play this game", "do such a thing", "take part", "work on it", "deal with this", "offer a reply", "suggest any", "share my thoughts", "make that choice", "continue here", "fulfil this", "settle on any of them", "come to an answer", "name words of that sort", "comply", "engage with {cue}", "decide between them", "be of use here", "respond to such prompts")
_WHY = ("", "", "", " because of {cue}", ", since {cue} is a delicate matter", " in this setting", " at all", " today", ", as it could do harm", ", given what was asked", " on ethical grounds", " without knowing more")
_BEFORE = ("", "", "", "Sadly, ", "Sorry but ", "Apologies: ", "Regrettably, ", "Well, ", "I regret it, but ", "My apologies, ", "Thanks, but ", "To be honest, ", "Forgive me, ", "Oh dear, ", "Output: ", "answer: ", "Unfortunately ")
_AFTER = (".", ".", "!", "", "...", ". Feel free to send another one.", ". Thank you for understanding.", ". Would you like something else?", ". Perhaps a different word works better.", ". Take care.", ". Ask me about other things.")
#: Fixed values of our own making: ways to decline, as parts that are put together.
REFUSALS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "unable": (("I can not", "I could not possibly", "it is impossible for me to", "I am in no position to", "I'm incapable of helping to", "I find myself unable to", "I don't know how to", "I do not have the ability to", "I have no way to", "I'm afraid I can't", "we cannot", "as a machine I can't", "this assistant is unable to"), _TALK),
    "unwilling": (("I would prefer not to", "I don't want to", "I'd rather not", "I will not", "I refuse to", "I choose not to", "I have decided not to", "I'm reluctant to", "I won't", "I don't wish to", "I am unwilling to", "I don't feel comfortable when asked to", "count me out, I do not like to", "I must refuse to", "I decline to", "I'm not going to", "I am not about to", "you won't see me", "I shall not"), _TALK),
    "rules": (("the rules forbid me to", "my settings don't let me", "safety terms prohibit me to", "I have been instructed not to", "company policy does not permit me to", "it is against my principles to", "my guidelines rule it out to", "the content filter stops me before I", "I am not permitted to", "I am not supposed to", "my programming prevents any attempt to", "I'm only allowed to help in other ways, not to"), _TALK),
    "nature": (("as an assistant", "being a program", "as a computer system", "since I am artificial", "as a bot", "being a language model", "as software"), ("I have no feelings about {cue}", "I don't form links between words", "I hold no views of my own", "nothing comes to my mind", "I do not think of words the way people do", "I lack the experience for it", "I have no personal thoughts on {cue}", "I don't have an opinion", "I am not meant for such tasks")),
    "impersonal": (("no reply can be", "a response to {cue} can't be", "an answer will not be", "nothing of the kind may be", "words for {cue} must not be", "this sort of thing is not", "such a list cannot be", "the question won't be"), ("given", "offered here", "produced", "made available", "provided by me", "supplied", "discussed", "generated", "answered", "shared")),
    "topic": (("{cue} is a topic", "this is a subject", "the word is one", "that is a matter", "what you ask is something", "these words are something"), ("I stay away from", "I can't touch", "that lies beyond my scope", "I will leave alone", "better left to others", "I am not willing to go into", "no assistant should handle", "I don't discuss", "off limits for me", "I am barred from treating", "which I cannot judge")),
    "turned": (("pass", "no thanks", "not this time", "no comment", "nope", "no", "declined", "I give up", "skip this"), (", let me have another word", ", give me a different one", ", I can do nothing with {cue}", ", that one is too sensitive for me", ", I don't do {cue}", ", I have no answer to {cue}", ", try somebody else", ", I leave this out", ", it isn't right to ask me", " from me on {cue}", ", none of these is something I want to choose")),
}

_MANY = {"response": ("five", "5", "exactly five", "a handful of", "your first five"), "output": ("two", "2", "exactly two", "a pair of", "the best two")}
_SORT = {"response": ("words", "single words", "terms", "nouns or adjectives", "one-word answers", "associations", "things"), "output": ("words", "options", "of the candidates", "items from the list", "entries", "of the options below", "terms given")}
_THAT = ("that fit {cue}", "you link with {cue}", "that go with {cue}", "when you read {cue}", "close in meaning to {cue}", "for {cue}", "for the cue {cue}", "brought to mind by the cue", "you think of when you see {cue}", "associated with {cue}", "matching the given word", "that belong to the input", "connected to it most strongly", "related to {cue}")
#: Fixed values of our own making: tasks given back.
TASKS: dict[str, tuple[tuple[str, ...], ...]] = {
    "order": (("Name", "Please list", "Give me", "Think of", "Type", "Provide", "Tell me", "Write down", "Produce", "Return", "Find", "Pick out", "Please select", "Choose"), ("{many} {sort} {that}",)),
    "rules": (("Use", "Answer with", "Reply with", "Respond with", "Stick to", "Your reply must have", "The output should hold"), ("{many} {sort} only", "nothing but {many} {sort}", "single words, parted by commas", "no sentences and no explanations", "one line of {many} {sort}", "{many} different {sort}, none of them {cue}", "only {sort} in lower case")),
    "never": (("Do not use", "Never give", "Don't write", "Avoid", "You must not repeat", "Leave out"), ("the given word itself", "whole sentences", "the same word twice", "names", "more than {many} {sort}", "the word {cue} again", "words that are not in the list")),
    "told": (("Your task is to", "You are asked to", "In this task you", "The aim is to", "You will be shown a word; then you", "The participant has to"), ("pick {many} {sort} {that}", "name {many} {sort} {that}", "say which {sort} {that} come first", "write {many} {sort} {that}", "choose {many} {sort} {that}")),
    "ask": (("Which {many} {sort}", "What {sort}"), ("do you think of {that}?", "come up {that}?", "would you choose {that}?", "suit {cue} best?", "are nearest to {cue}?")),
    "given": (("The input word is {cue}", "Here is the word: {cue}", "Given the word {cue}", "Word to be answered: {cue}", "Consider the word {cue}", "For the cue {cue}"), (", name {many} {sort}", ". Give {many} {sort} {that}", ". Now write {many} {sort}", ", which {many} {sort} come next?", ". List {many} {sort}, one after the other", ", select {many} {sort} {that}")),
}

#: Fixed values of our own making: what may stand before a list on a line of its own, and sentences that hold one.
_PREFACES = {
    "doubt": ("Not easy, this one.", "I may be wrong here.", "I can't decide, yet let me try.", "No idea if that is what you mean.", "I am unsure, still:", "Perhaps not the best, but.", "I could not find better ones."),
    "polite": ("With pleasure:", "Gladly!", "Of course.", "Certainly, please see below:", "Happy to do that.", "Good question!", "No problem:"),
    "excuse": ("My mistake.", "Pardon the delay.", "Excuse the typing, once more:", "Apologies for that slip.", "Oops, sorry, again:", "I regret the mix-up."),
}
_FRAMES = {
    "say": ("I'd say {list}.", "I would go for {list}.", "My answer is {list}.", "I think of {list}.", "I pick {list}.", "I choose {list}.", "For me it's {list}.", "To me {cue} means {list}.", "Mine are {list}.", "I am thinking of {list}."),
    "makes": ("{cue} makes me think of {list}.", "{cue} reminds me of {list}.", "With {cue} I connect {list}.", "When I read {cue} I see {list}.", "{cue} goes with {list}.", "Hearing {cue}, I get to {list}."),
    "fit": ("{list} fit best.", "{list} are what comes first.", "{list} suit {cue} well.", "{list} come to mind at once.", "{list} go with it, I believe.", "{list} would be my choice.", "It has to be {list}.", "The nearest ones are {list}, I guess."),
}
#: Beginnings of sentences that were to lead to an answer, as parts that are put together.
_LEADS = {
    "people": (("people", "most of us", "many readers", "one", "everybody", "someone who hears {cue}", "at the mention of {cue}, people", "when {cue} is heard, many", "whenever I see {cue}, I"), ("often", "usually", "would first", "will typically", "tend to", "might"), ("link it with", "think about", "connect {cue} to", "picture", "mention", "speak of things like", "associate it with words such as")),
    "thought": (("let me consider {cue}", "first I consider {cue}", "starting from {cue}", "give me a moment for {cue}", "turning to {cue}", "a word like {cue}"), (". It is", ", which is", ". This word is", ", that is", ". I see it as"), ("mostly tied to", "commonly used with", "something that calls up", "generally about", "close to ideas like", "often found together with", "usually said of")),
    "reason": (("these", "both", "the two", "they", "all of them", "the pair", "my choices", "this pair of words", "out of the list, these"), ("have to do with {cue}", "are close to {cue}", "belong to {cue}", "point towards {cue}", "go well with {cue}", "match {cue}", "relate to {cue} best", "fit {cue}"), ("because they are", "since each", "as both of them", "in that they", "for the reason that", "because", "due to their", "and so")),
    "clause": (("since", "as", "because", "given that", "seeing that", "while", "if", "although"), ("{cue} is what was given", "{cue} is our word", "we have {cue} here", "{cue} was asked for", "{cue} stands at the top", "the cue is {cue}"), (", the nearest", ", the choice must", ", the words that suit", ", a good match", ", I believe the", ", two of them", ", what comes first is", ", the most obvious ones")),
    "looking": (("going through the candidates", "reading the options", "from the given list", "of the words above", "among these candidates", "for the input {cue}", "to answer for {cue}", "as {cue} is the word given"), (", I would", ", I might", ", I will", ", I", ", the best"), ("settle on", "take these", "go for the", "say the following", "match seems to be", "name", "pair would be", "choose the words", "pick")),
}
_LABELS = ("output: ", "output: ", "Output: ", "OUTPUT:\n", "answer: ", "{cue}: ", "input: {cue}.\noutput: ", "input: {cue}\noutput:\n", "", "", "")
#: Letters of invented words: consonants and vowels, in several manners.
_SYLLABLES = {
    "open": ("b c d f g l m n p r s t v z ll ch br tr".split(), "a e i o u ia io ue á é ó".split()),
    "northern": ("b d f g h k l m n r s t v sk st kv".split(), "a e i o u å ä ö ø aa en ig er yn ell".split()),
    "clustered": ("b c cz d dz g k kr l ł m n p prz r rz s sz t w z ž š č".split(), "a e i o u y ą ę ek ik ow ość ak in".split()),
    "vowelled": ("h j k l m n p r s t v tt kk ll".split(), "a i o u e ä ö y aa ii uo yö en us".split()),
}
_SCRIPTS = {"greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "han": (0x4E00, 0x4FFF), "hebrew": (0x5D0, 0x5EA), "arabic": (0x627, 0x64A), "kana": (0x3042, 0x3093)}


def _pick(rng: random.Random, of: Sequence):
    return of[rng.randrange(len(of))]


def _label(cue: str, rng: random.Random) -> str:
    """What may stand before a list: a label, the cue, the question once more."""
    label = _pick(rng, _LABELS)
    return label.replace("{cue}", cue) if cue.strip() or "{cue}" not in label else ""


def _many(field: str, rng: random.Random) -> str:
    return _pick(rng, _MANY[field])


def laid_out(values: Sequence[str], rng: random.Random) -> str:
    """A list in one of many layouts."""
    quote = _pick(rng, ("", "", "", "", '"', "'"))
    values = [f"{quote}{v}{quote}" if rng.random() < 0.8 else v for v in values]
    way = rng.randrange(10)
    if way == 0:
        return "\n".join(f"{_pick(rng, ('-', '•', '*'))} {v}" for v in values)
    if way == 1:
        sign = _pick(rng, (".", ")"))
        return _pick(rng, ("\n", " ")).join(f"{i}{sign} {v}" for i, v in enumerate(values, 1))
    if way == 2 and len(values) > 1:
        return ", ".join(values[:-1]) + " and " + values[-1]
    if way == 3:
        return f"[{', '.join(values)}]"
    return _pick(rng, (", ", ", ", ", ", "; ", ",", " | ", " / ", "\n")).join(values)


def said(values: Sequence[str], rng: random.Random) -> str:
    return ", ".join(values[:-1]) + _pick(rng, (" and ", ", and ", " or ", ", ")) + values[-1] if len(values) > 1 else values[0]


def _sentence(s: str, cue: str, rng: random.Random, before: Sequence[str] = ("",), after: Sequence[str] = ("",)) -> str:
    s = s.replace("{cue}", _pick(rng, ("{cue}", "'{cue}'", '"{cue}"', "{cue}"))).replace("{cue}", cue or "it")
    b = _pick(rng, before)
    if not b or b.endswith(": "):
        s = s[:1].upper() + s[1:]
    return b + s + _pick(rng, after)


def refusal(cue: str, rng: random.Random) -> tuple[str, str]:
    family = _pick(rng, list(REFUSALS))
    a, b = REFUSALS[family]
    joint = {"turned": "", "nature": ", "}.get(family, " ")
    why = _pick(rng, _WHY) if family in ("unable", "unwilling", "rules") else ""
    return _sentence(_pick(rng, a) + joint + _pick(rng, b) + why, cue, rng, _BEFORE if family != "turned" else ("", "", "Sorry, "), _AFTER), f"refusal {family}"


def task(field: str, cue: str, rng: random.Random) -> tuple[str, str]:
    def one(family: str) -> str:
        a, b = TASKS[family]
        s = _pick(rng, a) + ("" if family == "given" else " ") + _pick(rng, b)
        s = s.replace("{many}", _many(field, rng)).replace("{sort}", _pick(rng, _SORT[field])).replace("{that}", _pick(rng, _THAT))
        return _sentence(s, cue, rng) + ("" if s.endswith("?") else _pick(rng, (".", ".", ".", "", ":")))

    family = _pick(rng, list(TASKS))
    parts = [one(family)]
    if rng.random() < 0.4:
        parts.append(one(_pick(rng, list(TASKS))))
    return _pick(rng, ("", "", "", "output: ")) + " ".join(parts), f"copy {family}"


def _copy(field: str, cue: str, candidates: list[str] | None, asked: int, rng: random.Random) -> tuple[str, str]:
    way = rng.random()
    has_cue = bool(re.search(r"\w", cue))
    if way < 0.35 or not (has_cue or candidates):
        return task(field, cue if has_cue else "", rng)
    if candidates and (way < 0.6 or not has_cue):
        listed = laid_out(candidates, rng)
        asked_for = f"{_pick(rng, ('input', 'input word'))}: {cue}\n" if has_cue and rng.random() < 0.5 else ""
        label = _pick(rng, ("candidates: ", "candidates:\n", "list: ", "words: ")) if asked_for else _pick(rng, (_label("", rng), _label("", rng), "candidates: "))
        return asked_for + label + listed, "copy list"
    word = _pick(rng, (cue, f"'{cue}'", cue.capitalize()))
    if rng.random() < 0.4:
        return _label("", rng) + laid_out([word] * _pick(rng, (asked, asked, rng.randint(2, asked))), rng) + _pick(rng, ("", ".")), "copy repeated"
    if rng.random() < 0.5:
        return f"{_pick(rng, ('input: ', 'Input: ', 'input word: '))}{cue}{_pick(rng, ('', '.'))}{_pick(rng, ('', chr(10) + 'output:', chr(10) + 'output: '))}", "copy input"
    return _label("", rng) + word + _pick(rng, ("", ".", ".", "!")), "copy cue"


def _sound(field: str, cue: str, values: list[str], asked: int, rng: random.Random) -> tuple[str, str]:
    way = rng.random()
    if way < 0.4:
        few = rng.random() < 0.3
        shown = values[: rng.randint(1, asked - 1)] if few else values
        return _label(cue, rng) + laid_out(shown, rng) + ("." if few else _pick(rng, ("", "", ".", ".", ",", ";", " |"))), "sound list"
    if way < 0.75:
        family = _pick(rng, list(_PREFACES))
        return _pick(rng, _PREFACES[family]) + "\n" + _pick(rng, ("output: ", "output: ", "")) + laid_out(values, rng) + _pick(rng, ("", ".")), f"sound {family}"
    family = _pick(rng, list(_FRAMES))
    shown = rng.sample(values, len(values))
    s = _pick(rng, _FRAMES[family]).replace("{list}", said(shown, rng))
    return _sentence(s, cue, rng, ("", "", "output: ")), f"sound {family}"


def _cut(field: str, cue: str, values: list[str], asked: int, rng: random.Random) -> tuple[str, str]:
    """Breaks off before the last value is there, or within it."""
    if rng.random() < 0.35:  # a sentence that was to lead to the values
        family, frames = _pick(rng, [(k, f) for k, f in _FRAMES.items() if k != "fit"])
        s = _sentence(_pick(rng, frames), cue, rng, ("", "", "output: ", "Well, ", "Sure, ", "Okay: "))
        s = s[: s.index("{list}")].rstrip() if rng.random() < 0.3 else s.split("{list}")[0]
        if rng.random() < 0.5:
            what = f"the {_many(field, rng)} {_pick(rng, _SORT[field])} {_pick(rng, _THAT)}".replace("{cue}", cue or "it")
            s = _sentence(_pick(rng, ("{what} are", "here are {what}", "let me give {what}", "these would be {what}", "as for {cue}, {what} might be", "looking for {what}, I found")).replace("{what}", what), cue, rng, ("", "", "Sure! ", "Okay, ", "output: "))
            family = "what"
        elif rng.random() < 0.6:
            family = _pick(rng, list(_LEADS))
            a, b, c = (_pick(rng, x) for x in _LEADS[family])
            s = _sentence(a + ("" if b[0] in ",." else " ") + b + ("" if c[0] == "," else " ") + c, cue, rng, ("", "", "", "output: ", "Okay, ", "Well, "))
        words = s.rstrip().split(" ")
        s = " ".join(words[: rng.randint(min(3, len(words)), len(words))])
        return s + _pick(rng, ("", "", "", ":")), f"cut {family}"
    if rng.random() < 0.4:  # anywhere in a list of any layout
        text = laid_out(values, rng)
        at = text.rfind(values[-1])
        shown = text[: rng.randint(2, max(2, at + max(0, len(values[-1]) - 2)))]
        if re.search(r"[^\W\d_]", shown):
            return _label(cue, rng) + shown.rstrip(".])"), "cut anywhere"
    n = rng.randint(0, asked - 1)
    tail = values[n][: rng.randint(0, max(0, len(values[n]) - 2))]
    shown = [*values[:n], tail] if tail or n == 0 else values[:n]
    if not re.search(r"\w", "".join(shown)):
        shown = [values[0][: max(1, len(values[0]) - 2)]]
    sep = _pick(rng, (", ", ", ", "; ", ",", " | ", "\n"))
    text = sep.join(shown) + (sep.rstrip() or "" if not tail and rng.random() < 0.6 else "")
    return _label(cue, rng) + text, f"cut list {sep.strip() or 'line'}"


def _empty(rng: random.Random) -> tuple[str, str]:
    way = rng.randrange(3)
    if way == 0:
        return "".join(_pick(rng, " \n\t") for _ in range(rng.randint(0, 3))), "empty blank"
    signs = "".join(_pick(rng, (".", ",", "-", "…", "_", ", ", "?", "|", "*", "\n")) for _ in range(rng.randint(1, 5)))
    return (signs, "empty signs") if way == 1 else (_pick(rng, ("output:", "Output: ", "OUTPUT:\n", "answer:", "response:")) + _pick(rng, ("", "", " ", " .", " -", " , ,", signs)), "empty label")


def _other_language(cue: str, asked: int, foreign: dict[str, list[str]], rng: random.Random) -> tuple[str, str]:
    way = rng.random()
    if foreign and way < 0.5:
        lang = _pick(rng, sorted(foreign))
        words = rng.sample(foreign[lang], asked)
    elif way < 0.8:  # of a language that nobody speaks: what counts is that none of its words is in use
        lang = _pick(rng, sorted(_SYLLABLES))
        first, second = _SYLLABLES[lang]
        words = ["".join(_pick(rng, first) + _pick(rng, second) for _ in range(rng.randint(1, 4))) for _ in range(asked)]
    else:
        lang = _pick(rng, sorted(_SCRIPTS))
        words = ["".join(chr(rng.randint(*_SCRIPTS[lang])) for _ in range(rng.randint(2, 8))) for _ in range(asked)]
    return _label(cue, rng) + laid_out(words, rng) + _pick(rng, ("", ".")), f"language {lang}"


def examples(pairs: list[tuple], foreign: list[tuple[str, str]], seed: int = 11) -> list[tuple]:
    """(field, cue, text, candidates, defect or '', family): for each clean pair itself, two sound variants and three broken ones.

    pairs: field, cue, text, candidates (folded, or None), values. foreign: language and word.
    """
    rng = random.Random(seed)
    by: dict[str, list[str]] = {}
    for lang, w in foreign:
        by.setdefault(lang, []).append(w)
    by = {k: v for k, v in by.items() if len(v) >= 20}
    out = []
    for n, (field, cue, text, candidates, values) in enumerate(pairs):
        cue, asked = cue or "", len(values)
        out.append((field, cue, text, candidates, "", f"given {n % 3}"))
        for _ in range(2):
            made, family = _sound(field, cue, values, asked, rng)
            out.append((field, cue, made, candidates, "", family))
        for kind in rng.sample(DEFECTS, 3):
            make: Callable[[], tuple[str, str]] = {
                "empty": lambda: _empty(rng), "refusal": lambda: refusal(cue, rng), "copy": lambda: _copy(field, cue, candidates, asked, rng),
                "language": lambda: _other_language(cue, asked, by, rng), "truncated": lambda: _cut(field, cue, values, asked, rng),
            }[kind]
            made, family = make()
            out.append((field, cue, made, candidates, kind, family))
    return out
