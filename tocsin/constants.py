"""They must stay as they are for results to match."""

# --- fixed values: target classes in report order -------------------------
CLASSES = [
    "Critical Rescue",
    "Resource Requests",
    "Situational Awareness",
    "Volunteering and Donations",
    "Irrelevant",
]

# --- fixed values: raw label -> target class ------------------------------
LABEL_MAP = {
    "displaced_people_and_evacuations": "Critical Rescue",
    "injured_or_dead_people": "Critical Rescue",
    "missing_or_found_people": "Critical Rescue",
    "requests_or_urgent_needs": "Resource Requests",
    "rescue_volunteering_or_donation_effort": "Volunteering and Donations",
    "caution_and_advice": "Situational Awareness",
    "infrastructure_and_utility_damage": "Situational Awareness",
    "other_relevant_information": "Situational Awareness",
    "sympathy_and_support": "Irrelevant",
    "not_humanitarian": "Irrelevant",
    "dont_know_cant_judge": "Irrelevant",
}

# --- fixed values: expected sources ---------------------------------------
EVENTS = {
    "set1": [
        "canada_wildfires_2016",
        "cyclone_idai_2019",
        "ecuador_earthquake_2016",
        "hurricane_harvey_2017",
        "hurricane_irma_2017",
        "hurricane_maria_2017",
        "hurricane_matthew_2016",
        "italy_earthquake_aug_2016",
        "kaikoura_earthquake_2016",
        "puebla_mexico_earthquake_2017",
        "srilanka_floods_2017",
    ],
    "set2": [
        "california_wildfires_2018",
        "hurricane_dorian_2019",
        "hurricane_florence_2018",
        "kerala_floods_2018",
        "midwestern_us_floods_2019",
        "pakistan_earthquake_2019",
    ],
}
SPLITS = ["train", "dev", "test"]

# --- fixed values: error analysis groups ----------------------------------
URGENT = ["Critical Rescue", "Resource Requests"]
NON_URGENT = ["Situational Awareness", "Irrelevant"]

# --- fixed values: order in which a free-text response is searched --------
RESPONSE_LABELS = [
    "Situational Awareness",
    "Volunteering and Donations",
    "Critical Rescue",
    "Irrelevant",
    "Resource Requests",
]

# --- fixed values: openings that mark a generated row as unusable ---------
BAD_PREFIXES = [
    "here are", "here is", "sure,", "sure!", "note:", "example:",
    "tweet:", "certainly", "of course", "i'll", "i will", "as an ai",
]

# --- fixed values: generation budget --------------------------------------
TARGET_ROWS = 2500
ROWS_PER_CALL = 10
SEEDS_PER_CALL = 5
MIN_WORDS = 4
MAX_WORDS = 60
FINGERPRINT_WORDS = 8

# --- fixed values: feature and model settings -----------------------------
MAX_FEATURES = 30_000
MIN_DF = 3
MAX_DF = 0.95
ALPHA = 0.1
ALPHAS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0]

# --- fixed values: English stop words, then the message-specific extras ---
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
EXTRA_STOP_WORDS = [
    "rt", "amp", "via", "like", "got", "get", "one", "two", "new",
    "would", "could", "also", "us", "go", "say", "https", "co",
]
STOP_WORDS = ENGLISH_STOP_WORDS + EXTRA_STOP_WORDS
