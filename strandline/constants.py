"""Results have to use exactly these."""

# Event tables.
MISSING_TIME = "000000"
SPECIAL_CHANNEL = 1111
MISSING_TEXT = "-"
CURRENT_END_DATE = "9999-12-31"

# Labelled windows.
N_CLASSES = 7
DAYS_AHEAD = 7
DAYS_BACK = 30

# Vocabulary: the special pieces take the ids 0 to 4 in this order.
SPECIAL_PIECES = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")
UNK, PAD, CLS, SEP, MASK = range(5)
CONTINUATION = "##"
MIN_FREQUENCY = 20
MAX_VOCABULARY = 1_000_000
NOT_A_LETTER = "[^가-힣0-9a-zA-Z]"

# Encoded rows.
WIDTH = 256
CHUNK = 254
IGNORE = -100
TAIL_WORDS = 5
MASK_PROBABILITY = 0.15
TOKEN_MASK_PROBABILITY = 0.1
MIN_MASKED_TOKENS = 50

# Splits, samples and decisions.
TEST_SHARE = 0.2
VALID_SHARE = 0.1
SAMPLE_SHARE = 0.1
SEED = 42
THRESHOLD = 0.5

# Size of the id table of each customer feature; id 0 stands for a missing value.
FEATURE_SIZES = {
    "cust_id1": 2,
    "cust_id2": 5,
    "cust_id3": 5,
    "cust_id4": 5,
    "cust_id5": 6,
    "cust_id6": 6,
    "cust_id7": 6,
    "cust_id8": 6,
    "cust_id9": 6,
    "cust_id10": 10,
}
