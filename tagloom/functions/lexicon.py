"""Fixed values of the tag schema. They are part of the data format and must not be changed."""

# Prefixes of tags, and tokens that are tags as a whole.
TAG_PREFIXES = ["ENTITY_", "INTENT_", "EMOTION_", "GENDER_", "AGE_", "DIALECT_", "KEYWORD_", "LANG_", "OTHER_", "ROLE_", "SPEAKER_", "TURN_", "FAMILY_"]
EXACT_TAGS = ["END", "TURN_CHANGE"]
SENTENCE_PREFIXES = ["AGE_", "GENDER_", "EMOTION_", "INTENT_", "DIALECT_"]
NEW_TOKEN_PREFIXES = ["ENTITY_", "INTENT_", "EMOTION_", "GENDER_", "AGE_", "DIALECT_", "KEYWORD_", "LANG_", "OTHER_"]

# Canonical tags of the closed families.
AGES = ["AGE_0_18", "AGE_18_30", "AGE_30_45", "AGE_45_60", "AGE_60PLUS"]
GENDERS = ["GENDER_FEMALE", "GENDER_MALE", "GENDER_OTHER", "GENDER_UNKNOWN"]
EMOTIONS = ["EMOTION_ANGRY", "EMOTION_DISGUST", "EMOTION_FEAR", "EMOTION_HAPPY", "EMOTION_NEUTRAL", "EMOTION_SAD", "EMOTION_SURPRISE"]
FORBIDDEN_AGES = ["AGE_NUMBER", "AGE_STATE"]
INTENTS = ["COMMAND", "DESCRIBE", "EXCLAIM", "EXPLAIN", "INFORM", "OPINION", "QUESTION", "REQUEST", "STATEMENT"]

# Tags renamed as a whole.
TAG_RENAMES = {
    "GER_MALE": "GENDER_MALE", "GER_FEMALE": "GENDER_FEMALE", "GER_OTHER": "GENDER_OTHER", "GER_M": "GENDER_MALE", "GER_F": "GENDER_FEMALE",
    "GERDER_MALE": "GENDER_MALE", "GERDER_FEMALE": "GENDER_FEMALE", "GERDER_OTHER": "GENDER_OTHER", "GERDER_M": "GENDER_MALE", "GERDER_F": "GENDER_FEMALE",
    "EMOTION_NEU": "EMOTION_NEUTRAL", "EMOTION_ANG": "EMOTION_ANGRY", "EMOTION_HAP": "EMOTION_HAPPY", "EMOTION_JOY": "EMOTION_HAPPY",
    "EMOTION_SADNESS": "EMOTION_SAD", "EMOTION_ANGER": "EMOTION_ANGRY",
    "INTENT_INFORMATIONAL": "INTENT_INFORM", "INTENT_EXCLAMATION": "INTENT_EXCLAIM", "INTENT_INSTRUCT": "INTENT_COMMAND",
}
MERGE_RENAMES = {"GER_MALE": "GENDER_MALE", "GER_FEMALE": "GENDER_FEMALE", "EMOTION_NEU": "EMOTION_NEUTRAL"}

# Emotions that are no emotions, and intents folded into the nine of INTENTS (all others become STATEMENT).
EMOTION_GARBAGE = ["AUDIO", "COMPLAINT", "DISAGREE", "EXPLAIN", "INFORM", "OPINION", "QUESTION", "THANK", "WISH"]
INTENT_FOLDS = {
    "REQUEST": [
        "SUGGEST", "SUGGESTION", "RECOMMEND", "RECOMMENDATION", "PROPOSE", "PROPOSAL", "OFFER", "INVITE", "PERSUADE", "ENCOURAGE", "MOTIVATE", "INSPIRE",
        "PLEA", "APPEAL", "PRAY", "NEGOTIATE", "DESIRE", "NEED",
    ],
    "INFORM": [
        "ANNOUNCE", "REPORT", "STATE", "AGREE", "AFFIRM", "ACKNOWLEDGE", "ACKNOWLEDGEMENT", "CONFIRM", "PROMISE", "ASSURE", "PLAN", "UPDATE", "WARN",
        "WARNING", "ALERT", "NOTIFICATION", "REMINDER", "REMIND", "ANNOUNCEMENT", "INFORMATION", "INFORMATIVE", "AFFIRMATION", "AFFIRMATIVE", "CORRECT",
        "ADVISE", "ADVICE", "REASSURE", "PROBLEM", "PROBLEM_SOLVING", "UNDERSTANDING", "INTENTION", "ADDRESS", "AGREEMENT",
    ],
    "DESCRIBE": [
        "NARRATE", "NARRATIVE", "RECOUNT", "REMEMBER", "RECALL", "REMINISCE", "ANECDOTE", "TELL_STORY", "DESCRIPTION", "DESCRIPTIVE", "DESCRIBE_ACTION",
        "RECOLLECT", "EXPERIENCE", "NARRATION", "ANECDOTAL", "PERSONAL_EXPERIENCE", "QUOTE", "MEMORY", "PERSONAL", "DESCRIPTIVE_ACTION",
    ],
    "OPINION": [
        "ARGUE", "DEBATE", "DISAGREE", "PREDICT", "SPECULATE", "SPECULATION", "HOPE", "HYPOTHETICAL", "HYPOTHESIS", "HYPOTHESIZE", "PREFER", "PREFERENCE",
        "EXPRESS_OPINION", "REFLECT", "REFLECTIVE", "REFLECTION", "DENY", "REFUSE", "REJECT", "REFUSAL", "NEGATE", "NEGATION", "OPPOSE", "OBJECT",
        "CONTRADICT", "DISPUTE", "COMPLAIN", "COMPLAINT", "CRITICIZE", "CRITICISM", "CRITIQUE", "ACCUSE", "ACCUSATION", "PROTEST", "PRAISE", "COMPLIMENT",
        "APPRECIATE", "CONGRATULATE", "SUPPORT", "COMPARE", "COMPARISON", "CONTRAST", "EVALUATE", "ASSESS", "ANALYZE", "REVIEW", "FEEDBACK", "INSULT",
        "SPECULATIVE", "PREDICTION", "EXPECTATION", "INFER", "CONCERN", "DENIAL",
    ],
    "EXCLAIM": [
        "GREETING", "GREET", "FAREWELL", "WELCOME", "CLOSE", "THANK", "THANK_YOU", "THANKS", "THANKING", "THANKYOU", "EXPRESS_GRATITUDE",
        "EXPRESSION_OF_GRATITUDE", "APOLOGIZE", "APOLOGY", "WISH", "EXPRESS_WISH", "EXPRESS_EMOTION", "EXPRESSION", "EXPRESS", "EXPRESS_FEELING",
        "EXPRESS_AFFECTION", "EXPRESS_SYMPATHY", "EXPRESS_HOPE", "EXPRESS_FEAR", "EXPRESS_DESIRE", "EXPRESS_CONCERN", "EXPRESS_REGRET", "EXPRESS_APPROVAL",
        "EXPRESS_CONDOLENCES", "CONDOLENCE",
    ],
    "COMMAND": [
        "INSTRUCTION", "DIRECTIVE", "DEMAND", "ORDER", "PROHIBIT", "PLAY_MUSIC", "MUSIC_REQUEST", "PLAY_SONG", "PLAY_MEDIA", "MEDIA_REQUEST", "PLAY_REQUEST",
        "TASK", "ACTION", "CALL_TO_ACTION", "THREAT", "THREATEN", "TRAVEL",
    ],
    "QUESTION": [
        "WEATHER_QUERY", "INQUIRY", "INQUIRE", "QUERY", "REQUEST_INFORMATION", "VERIFY", "TEST", "CLARIFY", "UNDERSTAND", "CHALLENGE",
    ],
    "EXPLAIN": [
        "EXPLANATION", "EXPLANATORY", "REASON", "JUSTIFY",
    ],
}
INTENT_FOLD = {word: target for target, words in INTENT_FOLDS.items() for word in words}

# Age ranges in years, as a hyphenated tag has them, and the bracket of each.
AGE_RANGES = {
    "14-17": "0_18", "18-24": "18_30", "25-30": "18_30", "31-35": "30_45", "36-40": "30_45", "41-45": "45_60", "46-50": "45_60",
    "51-55": "45_60", "56-60": "45_60", "61-65": "60PLUS", "66-70": "60PLUS",
}
AGE_RANGES_SNAKE = {k.replace("-", "_"): v for k, v in AGE_RANGES.items()} | {"14_25": "18_30"}

# Brackets as (below, label); the last label is for all above.
AGE_BRACKETS = {
    "schema": ([(18, "0_18"), (30, "18_30"), (45, "30_45"), (60, "45_60")], "60PLUS"),
    "decades": ([(18, "0_17"), (25, "18_24"), (35, "25_34"), (45, "35_44"), (55, "45_54"), (65, "55_64")], "65PLUS"),
    "inclusive": ([(18, "0_17"), (30, "18_29"), (45, "30_44"), (60, "45_59")], "60PLUS"),
}
AGE_WORDS = {"twenties": 25, "thirties": 35, "fourties": 45, "fifties": 55, "sixties": 65, "seventies": 75, "eighties": 85, "nineties": 95}
AGE_WORD_DEFAULT = 20

# Emotion codes and their tags.
EMOTION_CODES = {
    "NEU": "NEUTRAL", "HAP": "HAPPY", "SAD": "SAD", "ANG": "ANGRY", "FEA": "FEAR", "DIS": "DISGUST", "SUR": "SURPRISE", "NEUTRAL": "NEUTRAL",
    "HAPPY": "HAPPY", "ANGRY": "ANGRY", "FEAR": "FEAR", "DISGUST": "DISGUST", "SURPRISE": "SURPRISE", "CONTEMPT": "CONTEMPT",
}

# Language families by scheme.
FAMILIES = {
    "annotations": {
        "ENGLISH": [
            "EN", "EN_IN",
        ],
        "EUROPEAN": [
            "FR", "DE", "ES", "IT", "PT", "NL", "DA", "FI", "SV", "ET", "GL", "CA", "EU", "RO",
        ],
        "SLAVIC": [
            "RU", "PL", "CS", "SK", "BG", "UK", "BE", "MK", "KA", "SR", "HR", "SL",
        ],
        "INDO_ARYAN": [
            "HI", "BN", "MR", "GU", "PA", "UR", "TA", "TE", "KN", "ML", "OR", "AS", "BH", "CH", "MG", "MT",
        ],
        "EAST_ASIAN": [
            "ZH", "JA", "KO", "MANDARIN",
        ],
    },
}
FAMILY_NAMES = ["ENGLISH", "EUROPEAN", "SLAVIC", "INDO_ARYAN", "EAST_ASIAN", "MULTI"]
LEGACY_FAMILY_NAMES = ["ENGLISH", "EUROPEAN", "SLAVIC", "INDO_ARYAN", "DRAVIDIAN", "MANDARIN", "INDIAN_LOW_RESOURCE"]
FAMILY_OF = {scheme: {lang: family for family, langs in table.items() for lang in langs} for scheme, table in FAMILIES.items()}

# Annotator columns and the prefixes of their tags.
TRAILING_FIELDS = {
    "legacy": [("audio_age", "AGE_"), ("audio_gender", "GENDER_"), ("audio_tonal_emotion", "EMOTION_"), ("nlp_intent", "INTENT_"), ("nlp_domain", "DOMAIN_")],
    "full": [
        ("audio_age", "AGE_"), ("audio_gender", "GENDER_"), ("audio_tonal_emotion", "EMOTION_"), ("audio_emotion_intensity", "EMOTION_INTENSITY_"),
        ("audio_speech_rate", "SPEECH_RATE_"), ("audio_volume", "VOLUME_"), ("audio_pitch", "PITCH_"), ("audio_prosody", "PROSODY_"),
        ("audio_voice_quality", "VOICE_QUALITY_"), ("audio_accent", "ACCENT_"), ("audio_disfluency", "DISFLUENCY_"),
        ("audio_background_noise_type", "NOISE_TYPE_"), ("audio_background_noise_level", "NOISE_LEVEL_"), ("audio_overlapping_speech", "OVERLAP_"),
        ("audio_speaker_count", "SPEAKER_COUNT_"), ("audio_audio_event", "AUDIO_EVENT_"), ("audio_music_presence", "MUSIC_"),
        ("audio_laughter", "LAUGHTER_"), ("audio_breathing", "BREATHING_"), ("audio_snr_quality", "SNR_"), ("nlp_intent", "INTENT_"),
        ("nlp_sentiment", "SENTIMENT_"), ("nlp_topic", "TOPIC_"), ("nlp_speech_act", "SPEECH_ACT_"), ("nlp_domain", "DOMAIN_"),
        ("nlp_formality", "FORMALITY_"), ("nlp_spam_label", "SPAM_"),
    ],
}

# Numbers that have a word of their own.
NUMBER_WORDS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "10": "ten",
    "11": "eleven", "12": "twelve", "13": "thirteen", "14": "fourteen", "15": "fifteen", "16": "sixteen", "17": "seventeen", "18": "eighteen",
    "19": "nineteen", "20": "twenty", "30": "thirty", "40": "forty", "50": "fifty", "60": "sixty", "70": "seventy", "80": "eighty", "90": "ninety",
    "100": "one hundred",
}

# Letters of the scripts that a language family is told by, in order of priority.
SCRIPTS = [("SLAVIC", "[\\u0400-\\u04FF]"), ("INDO_ARYAN", "[\\u0900-\\u097F]"), ("ENGLISH", "[a-zA-Z]"), ("INDO_ARYAN", "[\\u0600-\\u06FF]"), ("INDO_ARYAN", "[\\u0980-\\u09FF]")]

# Whitelists of interview annotations, with what stands for anything else.
INTERVIEW = {
    "role": (["INTERVIEWER", "INTERVIEWEE"], "INTERVIEWEE"),
    "emotion": (["NEUTRAL", "HAPPY", "SAD", "ANGRY", "FEAR", "SURPRISE", "DISGUST"], "NEUTRAL"),
    "age": (["20_30", "30_45", "45_60", "60PLUS", "CHILD"], "30_45"),
    "gender": (["MALE", "FEMALE", "OTHER"], "MALE"),
}
