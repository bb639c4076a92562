"""Normal form of short answers and question tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public answer-normalisation rules: contractions, number words, articles, punctuation.
CONTRACTIONS = {
    "aint": "ain't",
    "arent": "aren't",
    "cant": "can't",
    "couldve": "could've",
    "couldnt": "couldn't",
    "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've",
    "didnt": "didn't",
    "doesnt": "doesn't",
    "dont": "don't",
    "hadnt": "hadn't",
    "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've",
    "hasnt": "hasn't",
    "havent": "haven't",
    "hed": "he'd",
    "hed've": "he'd've",
    "he'dve": "he'd've",
    "hes": "he's",
    "howd": "how'd",
    "howll": "how'll",
    "hows": "how's",
    "Id've": "I'd've",
    "I'dve": "I'd've",
    "Im": "I'm",
    "Ive": "I've",
    "isnt": "isn't",
    "itd": "it'd",
    "itd've": "it'd've",
    "it'dve": "it'd've",
    "itll": "it'll",
    "let's": "let's",
    "maam": "ma'am",
    "mightnt": "mightn't",
    "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've",
    "mightve": "might've",
    "mustnt": "mustn't",
    "mustve": "must've",
    "neednt": "needn't",
    "notve": "not've",
    "oclock": "o'clock",
    "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at",
    "'ow'sat": "'ow's'at",
    "shant": "shan't",
    "shed've": "she'd've",
    "she'dve": "she'd've",
    "she's": "she's",
    "shouldve": "should've",
    "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've",
    "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll",
    "somebodys": "somebody's",
    "someoned": "someone'd",
    "someoned've": "someone'd've",
    "someone'dve": "someone'd've",
    "someonell": "someone'll",
    "someones": "someone's",
    "somethingd": "something'd",
    "somethingd've": "something'd've",
    "something'dve": "something'd've",
    "somethingll": "something'll",
    "thats": "that's",
    "thered": "there'd",
    "thered've": "there'd've",
    "there'dve": "there'd've",
    "therere": "there're",
    "theres": "there's",
    "theyd": "they'd",
    "theyd've": "they'd've",
    "they'dve": "they'd've",
    "theyll": "they'll",
    "theyre": "they're",
    "theyve": "they've",
    "twas": "'twas",
    "wasnt": "wasn't",
    "wed've": "we'd've",
    "we'dve": "we'd've",
    "weve": "we've",
    "werent": "weren't",
    "whatll": "what'll",
    "whatre": "what're",
    "whats": "what's",
    "whatve": "what've",
    "whens": "when's",
    "whered": "where'd",
    "wheres": "where's",
    "whereve": "where've",
    "whod": "who'd",
    "whod've": "who'd've",
    "who'dve": "who'd've",
    "wholl": "who'll",
    "whos": "who's",
    "whove": "who've",
    "whyll": "why'll",
    "whyre": "why're",
    "whys": "why's",
    "wont": "won't",
    "wouldve": "would've",
    "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've",
    "yall": "y'all",
    "yall'll": "y'all'll",
    "y'allll": "y'all'll",
    "yall'd've": "y'all'd've",
    "y'alld've": "y'all'd've",
    "y'all'dve": "y'all'd've",
    "youd": "you'd",
    "youd've": "you'd've",
    "you'dve": "you'd've",
    "youll": "you'll",
    "youre": "you're",
    "youve": "you've",
}
NUMBER_WORDS = {
    "none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
ARTICLES = ["a", "an", "the"]
PUNCTUATION = [
    ";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!",
]


def _lookup(words: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w))


def strip_punctuation(text: Column) -> Column:
    """Marks next to a space (or any mark once a 1,000-style comma occurs) vanish, others become a space."""
    comma = text.rlike(r"\d,\d")
    out = text
    for mark in PUNCTUATION:
        at_edge = F.contains(text, F.lit(mark + " ")) | F.contains(text, F.lit(" " + mark)) | comma
        out = F.replace(out, F.lit(mark), F.when(at_edge, "").otherwise(" "))
    return F.regexp_replace(out, r"\.(?!\d)", "")


def normalise_words(text: Column) -> Column:
    """Lower case, number words to digits, articles dropped, contractions restored."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    digits = _lookup(words, NUMBER_WORDS)
    kept = F.filter(digits, lambda w: ~w.isin(ARTICLES))
    return F.array_join(_lookup(kept, CONTRACTIONS), " ")


def normalise_answer(text: Column) -> Column:
    return F.replace(normalise_words(strip_punctuation(text)), F.lit(","), F.lit(""))


def question_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "[.,'!?\"()*#:;]", "")
    return F.filter(F.split(F.translate(bare, "-/", "  "), r"\s+"), lambda w: w != "")


# Tokens the caption scorers leave out.
CAPTION_PUNCTUATION = [
    "''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-", ".", "?", "!", ",", ":", "-", "--", "...", ";",
]


def caption_tokens(text: Column) -> Column:
    """Words and marks split apart, marks left out."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|\.\.\.|--|[^\s\p{L}\p{N}]"), F.lit(0))
    return F.filter(parts, lambda w: ~w.isin(CAPTION_PUNCTUATION))


def pair_lengths(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """Lengths left when the longer list (the second on a tie) is popped until both fit."""
    more, less = F.lit((limit + 1) // 2), F.lit(limit // 2)
    return F.least(a, F.greatest(F.lit(limit) - b, more)), F.least(b, F.greatest(F.lit(limit) - a, less))


def pair_truncate(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    n, m = pair_lengths(F.size(a), F.size(b), limit)
    return F.slice(a, 1, n), F.slice(b, 1, m)


def split_id(text: Column) -> Column:
    """'train-5' -> 5; fixed offsets of one million for val, two for test."""
    parts = F.split(text, "-")
    number = parts[1].cast("long")
    return number + F.when(parts[0] == "val", 1_000_000).when(parts[0] == "test", 2_000_000).otherwise(0)


def extract_fields(text: Column, fields: dict[str, str]) -> Column:
    """Structs of all matches of one pattern per field, aligned by order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias(name) for name, p in fields.items()]
    return F.arrays_zip(*found)


def substitute_names(tokens: Column, objects: Column, names: Column, pick: Column) -> tuple[Column, Column]:
    """Placeholder tokens '[i]' become the object's name, a person a neutral name chosen by ``pick``.

    Also gives the object index per token, -1 where a token names none.
    """
    def index(t: Column) -> Column:
        return F.coalesce(F.regexp_extract(t, r"^\[(\d+)\]$", 1).try_cast("int"), F.lit(-1))

    def name(t: Column) -> Column:
        i = index(t)
        own = F.get(objects, i)
        return (
            F.when(i < 0, t)
            .when(own == "person", F.get(names, F.pmod(pick + i, F.size(names)).cast("int")))
            .otherwise(F.coalesce(own, t))
        )

    return F.transform(tokens, name), F.transform(tokens, index)
