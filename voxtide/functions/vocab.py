"""Fixed values and seed vocabularies.

Lists under "Fixed values" must be what they are for results to be right. The
seed vocabularies below them are this library's own and can be replaced by
passing another table to the operator that takes it.
"""

from __future__ import annotations

import unicodedata
from html.entities import html5

# ---- Fixed values ---------------------------------------------------------

BLOCKLIST = [
    "buy now", "click here", "dm me", "dm for", "free giveaway",
    "check out my", "follow me", "subscribe to", "limited offer",
    "act now", "sign up free", "earn money", "make money",
    "discount code", "promo code", "use code",
]
MIN_TEXT_LENGTH = 15
MAX_URLS = 3
MAX_HASHTAGS = 5

BOT_PHRASES = [
    "i am a bot", "this is an automated", "auto-generated",
    "this action was performed automatically", "beep boop", "generated by",
    "posted automatically", "this is a bot",
]
MIN_WORD_COUNT = 10
COMMENT_BOT_SENTENCE = "i am a bot, and this action was performed automatically"

PRESET_QUERIES = [
    "AI for coding", "AI for writing", "AI for research", "AI in education",
    "AI at work", "generative AI", "AI replacing jobs", "AI hype",
    "AI bubble", "AI overrated", "AI game changer", "AI ethics", "AI bias",
    "trust AI", "AI productivity", "AI workflow",
]
DEFAULT_QUERY = "AI tools"
DEFAULT_CAP = 100
PRESET_CAP = 1000

RELEVANCE_CANDIDATES = {
    "personal opinion about AI tools": "relevant",
    "spam or advertisement": "spam",
    "unrelated to AI tools": "off_topic",
}
SARCASM_HYPOTHESES = {
    "sarcastic": "This text about an AI tool is sarcastic and expresses criticism or mockery indirectly.",
    "non-sarcastic": "This text about an AI tool is literal, sincere, and does not use sarcasm.",
}
EVALUATION_LABELS = {
    "LABEL_0": "non-sarcastic", "LABEL_1": "sarcastic",
    "non_sarcasm": "non-sarcastic", "sarcasm": "sarcastic",
    "not_sarcasm": "non-sarcastic",
}
KAPPA_BANDS = [(0.20, "slight"), (0.40, "fair"), (0.60, "moderate"), (0.80, "substantial")]

# ---- Seed vocabularies (own) ----------------------------------------------

# Every named entity of HTML 5 that ends in a semicolon, from Python's own table; a hard space is a space.
HTML_ENTITIES = {f"&{name}": chars for name, chars in sorted(html5.items()) if name.endswith(";")} | {"&nbsp;": " "}

# (pattern, replacement), applied in order to text that holds an apostrophe.
CONTRACTION_RULES = [
    ("(?i)\\bcan't\\b", "cannot"),
    ("(?i)\\bwon't\\b", "will not"),
    ("(?i)\\bshan't\\b", "shall not"),
    ("(?i)\\bain't\\b", "are not"),
    ("(?i)\\blet's\\b", "let us"),
    ("(?i)\\by'all\\b", "you all"),
    ("(?i)\\b(it|he|she|that|this|what|who|where|there|here|how|when|why)'s\\b", "$1 is"),
    ("(?i)n't\\b", " not"),
    ("(?i)'re\\b", " are"),
    ("(?i)'ve\\b", " have"),
    ("(?i)'ll\\b", " will"),
    ("(?i)'d\\b", " would"),
    ("(?i)\\bi'm\\b", "I am"),
]

EMOJI_NAMES = {
    "😀": "grinning_face", "😃": "grinning_face_with_big_eyes", "😄": "grinning_face_with_smiling_eyes",
    "😁": "beaming_face_with_smiling_eyes", "😂": "face_with_tears_of_joy", "🤣": "rolling_on_the_floor_laughing",
    "😊": "smiling_face_with_smiling_eyes", "😍": "smiling_face_with_heart-eyes", "😎": "smiling_face_with_sunglasses",
    "🤔": "thinking_face", "😐": "neutral_face", "🙄": "face_with_rolling_eyes", "😢": "crying_face",
    "😭": "loudly_crying_face", "😡": "enraged_face", "😱": "face_screaming_in_fear", "👍": "thumbs_up",
    "👎": "thumbs_down", "👏": "clapping_hands", "🙏": "folded_hands", "🔥": "fire", "🎉": "party_popper",
    "💯": "hundred_points", "🚀": "rocket", "🤖": "robot", "💡": "light_bulb", "✅": "check_mark_button",
    "❌": "cross_mark", "⭐": "star", "❤": "red_heart", "💔": "broken_heart", "💩": "pile_of_poo",
}

# Where emoji stand in Unicode; names beyond those above follow the character's own.
EMOJI_RANGES = [(0x2600, 0x27BF), (0x2B50, 0x2B50), (0x1F300, 0x1FAFF)]
# Emoji among the signs of other blocks.
EMOJI_SIGNS = [
    (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA),
    (0x231A, 0x231B), (0x2328, 0x2328), (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6),
    (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D),
    (0x3297, 0x3297), (0x3299, 0x3299), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F171), (0x1F17E, 0x1F17F), (0x1F18E, 0x1F18E),
    (0x1F191, 0x1F19A), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A), (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251),
]


def _named(c: int) -> str:
    return unicodedata.name(chr(c)).lower().replace(" ", "_").replace("'", "")


# What a person joined with a thing is called.
EMOJI_TRADES = {
    "⚕": "health_worker", "⚖": "judge", "✈": "pilot", "🌾": "farmer", "🍳": "cook", "🎓": "student", "🎤": "singer", "🎨": "artist",
    "🏫": "teacher", "🏭": "factory_worker", "💻": "technologist", "💼": "office_worker", "🔧": "mechanic", "🔬": "scientist", "🚀": "astronaut", "🚒": "firefighter",
}
SKIN_TONES = {"🏻": "light", "🏼": "medium-light", "🏽": "medium", "🏾": "medium-dark", "🏿": "dark"}
EMOJI_NAMES = (
    {chr(c): _named(c) for low, high in EMOJI_RANGES for c in range(low, high + 1) if unicodedata.category(chr(c)) in ("So", "Sk")}
    | {chr(c): _named(c) for low, high in EMOJI_SIGNS for c in range(low, high + 1)}
    | {f"{person}\u200d{thing}": f"{name}_{trade}" for person, name in (("👩", "woman"), ("👨", "man")) for thing, trade in EMOJI_TRADES.items()}
    | {f"🧑\u200d{thing}": trade for thing, trade in EMOJI_TRADES.items()}
    | EMOJI_NAMES
)

IRREGULAR_LEMMAS = {
    "men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot",
    "teeth": "tooth", "mice": "mouse", "geese": "goose", "lives": "life", "wives": "wife",
    "knives": "knife", "leaves": "leaf", "shelves": "shelf", "thieves": "thief", "wolves": "wolf",
    "halves": "half", "selves": "self", "criteria": "criterion", "phenomena": "phenomenon",
    "analyses": "analysis", "bases": "basis", "crises": "crisis", "theses": "thesis",
    "hypotheses": "hypothesis", "indices": "index", "matrices": "matrix", "vertices": "vertex",
    "movies": "movie", "ties": "tie", "lies": "lie", "shoes": "shoe", "heroes": "hero",
    "potatoes": "potato", "news": "news", "always": "always", "perhaps": "perhaps",
    "does": "does", "goes": "goes", "series": "series", "species": "species",
}
# (ending, characters to cut, text to append): first match wins, shorter words stay.
LEMMA_SUFFIXES = [
    ("ss", 0, ""), ("us", 0, ""), ("is", 0, ""), ("as", 0, ""),
    ("ies", 3, "y"), ("ches", 2, ""), ("shes", 2, ""), ("sses", 2, ""),
    ("xes", 2, ""), ("zes", 2, ""), ("s", 1, ""),
]
LEMMA_MIN_LENGTH = 4

# Valence per word, from -4 to 4; these and the lists below are a selection from the
# lexicon published with Hutto & Gilbert (2014), which is under the MIT licence.
SENTIMENT_LEXICON = {
    "amazing": 2.8, "awesome": 3.1, "beautiful": 2.9, "benefit": 2.0, "benefits": 1.6, "best": 3.2,
    "better": 1.9, "brilliant": 2.8, "clever": 2.0, "cool": 1.3, "creative": 1.9, "easier": 1.8,
    "easy": 1.9, "effective": 2.1, "efficient": 1.8, "enjoy": 2.2, "excellent": 2.7, "exciting": 2.2,
    "fan": 1.3, "fantastic": 2.6, "favorite": 2.0, "fun": 2.3, "glad": 2.0, "good": 1.9, "great": 3.1,
    "happy": 2.7, "helpful": 1.8, "helps": 1.6, "hope": 1.9, "impressed": 2.1, "impressive": 2.3,
    "improve": 1.9, "improved": 2.1, "incredible": 2.3, "interesting": 1.7, "like": 1.5, "love": 3.2,
    "loved": 2.9, "loving": 2.9, "nice": 1.8, "perfect": 2.7, "positive": 2.6, "powerful": 1.8,
    "reliable": 1.9, "smart": 1.7, "solid": 0.6, "strong": 2.3, "success": 2.7, "super": 2.9,
    "support": 1.7, "thanks": 1.9, "trust": 2.3, "useful": 1.9, "valuable": 2.1, "win": 2.8,
    "wonderful": 2.7, "worth": 0.9, "wow": 2.8, "angry": -2.3, "annoying": -1.7, "awful": -2.0,
    "bad": -2.5, "biased": -1.1, "boring": -1.3, "broken": -2.1, "confusing": -0.9, "crap": -1.6,
    "dangerous": -2.1, "dead": -3.3, "disappointed": -2.1, "disappointing": -2.2, "disaster": -3.1,
    "dumb": -2.3, "error": -1.7, "evil": -3.4, "fail": -2.5, "failed": -2.3, "fake": -2.1, "fear": -2.2,
    "fraud": -2.8, "frustrating": -1.9, "garbage": -1.8, "harm": -2.5, "hate": -2.7, "horrible": -2.5,
    "hurt": -2.4, "lame": -2.1, "lie": -1.6, "lost": -1.3, "mess": -1.5, "negative": -2.7, "pathetic": -2.7,
    "poor": -2.1, "problem": -1.7, "problems": -1.7, "ruin": -2.8, "sad": -2.1, "scam": -2.7, "scary": -2.2,
    "shame": -2.1, "sick": -2.3, "stupid": -2.4, "sucks": -1.5, "terrible": -2.1, "threat": -2.4,
    "ugly": -2.3, "unfair": -2.1, "useless": -1.8, "waste": -1.8, "weak": -1.9, "worried": -1.2,
    "worse": -2.1, "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
}
BOOST_WORDS = [
    "absolutely", "amazingly", "completely", "considerably", "deeply", "enormously", "entirely",
    "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely", "incredibly",
    "intensely", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "unusually", "utterly", "very",
]
DAMPEN_WORDS = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly",
    "scarcely", "slightly", "somewhat", "sorta",
]
NEGATIONS = [
    "ain't", "aint", "aren't", "arent", "can't", "cannot", "cant", "couldn't", "didn't", "didnt",
    "doesn't", "doesnt", "don't", "dont", "hadn't", "hasn't", "haven't", "isn't", "isnt", "neither",
    "never", "no", "nobody", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom",
    "shouldn't", "wasn't", "weren't", "without", "won't", "wont", "wouldn't",
]
# Published rule constants (Hutto & Gilbert, 2014).
BOOST, BOOST_DECAY = 0.293, (1.0, 0.95, 0.9)
NEGATE, CAPS, EXCLAIM, MAX_EXCLAIM = -0.74, 0.733, 0.292, 4
QUESTION, QUESTION_MANY = 0.18, 0.96
BUT_BEFORE, BUT_AFTER, NORM_ALPHA = 0.5, 1.5, 15.0

# Weight of a term for a candidate label, in thousandths.
RELEVANCE_TERMS = {
    "personal opinion about AI tools": {
        "i": 400, "my": 500, "love": 900, "hate": 900, "think": 800, "tools": 700, "ai": 600,
        "workflow": 600, "useless": 700, "great": 500, "terrible": 700, "better": 400,
    },
    "spam or advertisement": {
        "buy": 1200, "offer": 1100, "limited": 900, "free": 700, "code": 400, "bot": 900,
        "automatically": 800, "https": 500, "discount": 1200,
    },
    "unrelated to AI tools": {"the": 20, "of": 15, "la": 60, "der": 60, "die": 60, "que": 60, "el": 60, "le": 60},
}
SUBJECTIVITY_TERMS = {
    "neutral": {"the": 15, "is": 30, "use": 300, "exist": 400, "report": 400, "of": 10, "la": 20, "der": 20},
    "opinionated": {
        "i": 400, "my": 400, "love": 900, "hate": 900, "terrible": 900, "useless": 800, "great": 800,
        "bad": 600, "best": 700, "worst": 900, "better": 500, "!": 200,
    },
}
POLARITY_TERMS = {
    "negative": {"terrible": 1000, "useless": 900, "waste": 800, "hate": 1000, "bad": 500, "worst": 1000},
    "positive": {"love": 1000, "great": 900, "better": 500, "best": 900, "amazing": 1000, "loving": 900},
}
SARCASM_TERMS = {
    "sarcastic": {"yeah": 500, "sure": 400, "wow": 500, "brilliant": 600, "great": 150, "waste": 300, "genius": 700},
    "non-sarcastic": {"love": 200, "tools": 200, "use": 200, "the": 10, "work": 200},
}
