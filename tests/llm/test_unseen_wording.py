"""Problem 6 on pairs worded by hand: no wording here stands in the training families or in the test tables."""

import random

import pytest

from lexiweave.llm.broken_pairs import broken_pairs

CAND = ["anchor", "brook", "candle", "drawer", "engine", "feather", "garlic", "hammock", "island", "jungle", "kettle", "ladder"]
REFUSED = [
    "I have to leave this one unanswered.", "This isn't a word I can talk about, sorry.", "Nope, not going there.", "I must respectfully refuse.", "My makers have told me not to react to such words.",
    "That request goes beyond what I'm permitted to handle.", "It would be wrong of me to respond.", "You'll have to ask a human for that.", "I do not feel able to name anything.", "We are not able to process this prompt.",
    "Unfortunately no suitable reply exists on my side.", "I'm declining this question.", "Sorry, I don't do free association.", "As a chatbot, I cannot associate anything with a storm.", "I don't think I should be answering that.",
    "Due to content restrictions I can't react to this.", "There is nothing I am willing to say here.", "Please excuse me from this round, I can't do it.", "I won't be choosing from that list.", "Neither option is something I'm comfortable picking.",
    "That would violate my terms of use.", "I am sorry, this falls under topics I do not cover.", "It's not possible for a language model to have associations.", "I'd rather we spoke about something else.", "Regretfully, I am not allowed to take a side.",
    "I have been told to avoid this subject, so no answer.", "Sorry! Can't.  I do not know what to say.", "I will not be giving an answer here", "Afraid I can't be of service with this word.", "No, I refuse.",
]
TASKS = [
    "Write the first five things that {cue} makes you think of.", "Please answer with five single words and nothing else.", "You must choose two of the candidates that go best with {cue}.", "Do not explain your answer, just give the words.",
    "Select the pair of words from the list that is most strongly associated with {cue}.", "Give five words, separated by commas.", "Your answer should consist of exactly two words from the list.", "Which two of these words are closest to {cue}?",
    "List five associations for the input word. Never repeat the input word.", "Respond only with the words, in lower case, one per line.", "Read the cue and write whatever five words come first.", "For the word {cue}, name five related words.",
    "Pick exactly two words. Don't use words that aren't listed.", "What are the first five words that come to mind for {cue}?", "Choose the two candidates you consider most related to the cue word.",
]
CUT = [
    "The words that first occur to me on hearing {cue} are probably", "Thinking about {cue}, I would start with", "Hmm, {cue} brings up images of", "Surely the closest terms here would have to be", "My five associations for {cue}:",
    "If I look at the candidates then the ones that", "I believe that {cue} is strongly linked to", "Okay! So for this word I", "There are several words which people connect with {cue}, for example", "The two I like most are",
    "After weighing all options I ended up with", "Here's what springs to mind for", "A {cue} is something that people use when they", "To me the strongest connection exists between {cue} and", "Looking for the best match, I decided that",
]
CUT_LISTS = ["kettle, lad", "ladder;", "feather, ", "output: islan", "Answer: brook,", "response: garlic, ham", "1. kettle 2.", "\"hammock\", ", "candle |", "- engine\n- fea"]
FOREIGN = [
    "fiume, montagna, pietra, sabbia, foglia", "rivière, montagne, pierre, sable, feuille.", "output: Fluss; Berg; Stein; Sand; Blatt", "rzeka, góra, kamień, piasek, liść.", "río / monte / piedra / arena / hoja",
    "река, гора, камень, песок, лист", "ποτάμι, βουνό, πέτρα, άμμος, φύλλο.", "川、山、石、砂、葉", "nehir, dağ, taş, kum, yaprak", "joki, vuori, kivi, hiekka, lehti.",
    "1. älv\n2. berg\n3. sten\n4. sand\n5. löv", "answer: folyó, hegy, kő, homok, levél", "نهر، جبل، حجر، رمل، ورقة", "rivier, heuvel, kiezel, zandbak, blaadje", "- řeka\n- hora\n- kámen\n- písek\n- list",
]
EMPTY = ["", "   ", "\n\n", "--", "?", "output:\n", "Answer: ...", "response: -", "_", "; ;"]
SOUND_FC = [
    "I guess kettle and ladder.", "island + brook would be mine, so: island, brook", "Both island and jungle fit.", "kettle, ladder", "Output: 'candle' and 'engine'.", "Tough call!\noutput: garlic, feather", "ladder / drawer.",
    "Going with anchor and island here.", "Sorry for being slow.\nanchor, island", "{cue}: hammock, jungle", "I can't think of better ones than candle and kettle.", "1) feather\n2) hammock", "The best two: engine, anchor.", "\"brook\", \"garlic\"", "(1) engine (2) ladder.",
]
SOUND_FA = [
    "I associate it with night, river, garden, lantern and tower.", "No clue whether this helps, but:\nnight, river, garden, lantern, tower", "night; river; garden; lantern; tower.", "output: night, river.", "* night\n* river\n* garden\n* lantern\n* tower",
    "Let me see...\noutput: market, bridge, candle, saddle, pocket.", "{cue} = night, river, bridge, anchor, market", "market, bridge.", "I'd say market, bridge, candle, saddle and pocket.", "[meadow, harbor, button, kettle, sofa]",
]


@pytest.fixture(scope="module")
def outcome(spark):
    rng = random.Random(4)
    voc = ["night", "station", "river", "candle", "bridge", "ladder", "pepper", "anchor", "market", "tower", "branch", "garden", "lantern", "saddle", "meadow", "pocket", "harbor", "button", "kettle", "sofa", *CAND]
    voc = sorted({*voc, "stone", "cloud", "wheel", "salt", "mirror", "pencil", "forest", "summer", "violin", "carpet", "lemon", "shadow", "window", "soldier", "orange", "thunder"})
    fa, fc, want = [], [], {}
    for i in range(900):
        fa.append((i, rng.choice(voc), f"output: {', '.join(rng.sample(voc, 5))}" + rng.choice(["", "."])))
        c = rng.sample(voc, 12)
        fc.append((i, rng.choice(voc), ", ".join(c), f"output: {', '.join(rng.sample(c, 2))}" + rng.choice(["", "."])))
    def put(field, text, kind):
        to = fa if field == "fa" else fc
        k = 10_000 + len(to)
        to.append((k, "storm", text.replace("{cue}", "storm")) if field == "fa" else (k, "storm", ", ".join(CAND), text.replace("{cue}", "storm")))
        want[field, k] = (kind, text)
    for k, t in enumerate(REFUSED):
        put("fa" if k % 2 else "fc", t, "refusal")
    for t in TASKS:
        put("fc" if "two" in t or "candidates" in t or "list" in t else "fa", t, "copy")
    for t in ("storm", "Storm, storm, storm.", "input: storm", ", ".join(CAND), "- " + "\n- ".join(CAND), "Options: " + "; ".join(CAND)):
        put("fc", t, "copy")
    for k, t in enumerate(CUT):
        put("fa" if k % 2 else "fc", t, "truncated")
    for t in CUT_LISTS:
        put("fc", t, "truncated")
    for t in FOREIGN:
        put("fa", t, "language")
    for k, t in enumerate(EMPTY):
        put("fa" if k % 2 else "fc", t, "empty")
    for t in SOUND_FC:
        put("fc", t, None)
    for t in SOUND_FA:
        put("fa", t, None)
    docs = spark.createDataFrame([(1, "de", "heute regnet es wieder und die alte brücke steht noch unter wasser"), (2, "fr", "cette semaine nous avons encore perdu deux parties contre les anciens"), (3, None, None)], "doc_id long, lang string, text string")
    tables = spark.createDataFrame(fc, "fc_id long, input_word string, candidates string, output string"), spark.createDataFrame(fa, "fa_id long, cue_word string, response string")
    got = {(r.pair_kind, r.rec_id): r.defect for r in broken_pairs(*tables, docs).collect()}
    return want, got


@pytest.mark.parametrize("kind", ["refusal", "copy", "truncated", "language", "empty", None])
def test_recall_of_each_kind(outcome, kind):
    want, got = outcome
    own = {k: t for k, (d, t) in want.items() if d == kind}
    wrong = [(t, got.get(k)) for k, t in own.items() if got.get(k) != kind]
    assert len(want) >= 100 and len(wrong) <= 0.1 * len(own), wrong


def test_the_rest_is_left_alone(outcome):
    want, got = outcome
    assert len([k for k in got if k not in want]) <= 5
