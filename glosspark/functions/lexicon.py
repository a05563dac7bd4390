"""Fixed values that must equal the reference's for identical results.

Stated plainly and in their original order; order matters wherever the
rules are applied one after another.
"""

# --- fixed values -----------------------------------------------------------

# Gloss pronoun markers, replaced as plain substrings in this order (v1).
PRONOUNS_V1 = [
    ("X-I", "I"),
    ("X-WE", "WE"),
    ("X-YOU", "YOU"),
    ("X-HE", "HE"),
    ("X-SHE", "SHE"),
    ("X-IT", "IT"),
    ("X-Y", "THEY"),
    ("X-MY", "MY"),
    ("SE", "THESE"),
]

# Same list in the v2 normaliser: only the X-Y entry differs.
PRONOUNS_V2 = [
    ("X-I", "I"),
    ("X-WE", "WE"),
    ("X-YOU", "YOU"),
    ("X-HE", "HE"),
    ("X-SHE", "SHE"),
    ("X-IT", "IT"),
    ("X-THEY", "THEY"),
    ("X-MY", "MY"),
    ("SE", "THESE"),
]

# Phrases the v2 gloss normaliser deletes (whole words, whitespace between).
V2_DROPPED_PHRASES = [
    ("SEE", "MINUTE"),
    ("MEMBERSHIP", "PARLIAMENT"),
    ("APPROVAL", "MINUTE"),
    ("DESC-PREVIOUS", "SIT"),
]

# Contractions expanded (whole word, case-insensitive) in this order.
CONTRACTIONS = [
    ("can't", "cannot"),
    ("won't", "will not"),
    ("don't", "do not"),
    ("doesn't", "does not"),
    ("didn't", "did not"),
    ("isn't", "is not"),
    ("aren't", "are not"),
    ("wasn't", "was not"),
    ("weren't", "were not"),
    ("haven't", "have not"),
    ("hasn't", "has not"),
    ("hadn't", "had not"),
    ("shouldn't", "should not"),
    ("wouldn't", "would not"),
    ("couldn't", "could not"),
    ("mustn't", "must not"),
    ("needn't", "need not"),
    ("i'm", "i am"),
    ("you're", "you are"),
    ("he's", "he is"),
    ("she's", "she is"),
    ("it's", "it is"),
    ("we're", "we are"),
    ("they're", "they are"),
    ("i've", "i have"),
    ("you've", "you have"),
    ("we've", "we have"),
    ("they've", "they have"),
    ("i'll", "i will"),
    ("you'll", "you will"),
    ("he'll", "he will"),
    ("she'll", "she will"),
    ("we'll", "we will"),
    ("they'll", "they will"),
]

# Institution words: articles are dropped before them (text -> gloss) and
# inserted before them (post-processing of generated text).
INSTITUTIONS = ["parliament", "commission", "council", "union", "budget",
                "report", "debate", "directive"]
INSTITUTIONS_POST = ["commission", "parliament", "council", "union", "budget",
                     "report", "debate", "directive"]

# Titles: surname -> title that replaces a preceding mr/mrs/ms.
TITLE_BY_SURNAME = {
    "angelilli": "mrs",
    "lamassoure": "mr",
    "bowles": "mrs",
    "pagano": "mrs",
    "scheele": "ms",
    "ashton": "baroness",
}
TITLES = ["mr", "mrs", "ms"]

# Gloss corrections applied per token (case-sensitive).
GLOSS_CORRECTIONS = {"COMMISSIONS": "COMMISSION", "PARLIAMENTS": "PARLIAMENT"}

# Paraphrases for paired augmentation, tried in this order.
PARAPHRASES = [
    ("i went", "i traveled"),
    ("i bought", "i purchased"),
    ("the store", "the shop"),
    ("yesterday", "the day before"),
    ("tomorrow", "the next day"),
    ("want to", "would like to"),
    ("need to", "have to"),
]

# Gloss tokens treated as optional by the "simplify" augmentation.
OPTIONAL_GLOSS_TOKENS = ["THE", "A", "AN"]

# Spatial markers removed from SIGNUM-style glosses.
SPATIAL_MARKERS = ["X-right", "X-left", "X-middle"]

# Vocabulary specials, ids 0..3.
SPECIALS = ["<pad>", "<sos>", "<eos>", "<unk>"]
PAD, SOS, EOS, UNK = 0, 1, 2, 3
LABEL_IGNORE = -100

# Prompt fan-out phrasings.
FANOUT_G2T = "convert gloss to text: "
FANOUT_T2G = "convert text to gloss: "

# Metric constants.
BLEU_EPSILON = 0.1          # smoothing method 1
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3.0, 0.5
DEFAULT_SEED = 42
