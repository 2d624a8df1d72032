"""Word lists, code tables and formats that decide results."""

# Labels a record can carry.
LABELS = ["olympic", "other_sport", "non_sport"]
DEFAULT_LABEL = "non_sport"
EMPTY_REASON = "empty_response"
TRUNCATED_REASON = "parse_truncated"
UNPARSED_REASON = "parse_error"
FAILED_REASON = "generation_failed"

# Stand-ins for a missing country.
NO_COUNTRY = "XX"
UNKNOWN_COUNTRY = "unknown"

# Multilingual sport terms, matched as case-insensitive substrings.
SPORT_TERMS = [
    "olymp", "medal", "athlet", "gymnast", "swim", "swimmer", "track", "field", "marathon",
    "football", "soccer", "tennis", "basket", "basketball", "baseball", "cricket", "hockey",
    "volley", "volleyball", "karate", "judo", "taekwondo", "rowing", "canoe", "kayak",
    "sprint", "relay", "fencing", "weightlift", "boxing", "mma", "surf", "skate", "skating",
    "ski", "snowboard",
    "olimpi", "olímp", "medalla", "atleta", "natación", "maratón", "fútbol", "baloncesto", "voleibol",
    "medalha", "natação", "maratona", "futebol", "remo", "ginástica",
    "médaille", "athlète", "natation", "gymnastique",
    "medaille", "leichtathletik", "schwimm", "turnen", "fußball",
    "olimp", "medaglia", "nuot", "ginnastica", "calcio",
    "олимп", "медал", "спорт", "атлет", "гимнаст", "бег", "плаван", "футбол", "теннис", "бокс",
    "올림", "메달", "선수", "체조", "수영", "달리기", "축구", "농구", "테니스",
    "オリンピ", "メダル", "選手", "体操", "水泳", "マラソン", "サッカー", "野球", "テニス",
    "khiladi", "खिलाड़ी", "दौड़", "मैरा", "क्रिकेट",
]

# Stems of the games themselves and of medal words.
GAMES_STEMS = [
    "olymp", "olimpi", "olímp", "olimpiá", "olympiad", "olympiade", "olympics",
    "올림픽", "オリンピック", "олимп", "奥运", "奥林匹克", "olympische", "olimpiadi",
    "medal", "medalha", "medalla", "medaglia", "podium", "podio", "gold", "silver", "bronze",
]

# Two-letter country to three-letter committee code.
COMMITTEE_CODES = {
    "DE": "GER", "FR": "FRA", "GB": "GBR", "IN": "IND", "JP": "JPN", "KR": "KOR",
    "CA": "CAN", "BR": "BRA", "US": "USA", "MX": "MEX", "RU": "RUS",
}

# Committee codes that stand for another one.
CODE_ALIASES = {"ROC": "RUS"}

# Texts a CSV cell may hold for "missing".
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Answer format a labeller is asked for.
LINE_FORMAT = (
    "\nAnswer using EXACTLY the following format (no extra text):\n"
    "Label: <one of olympic | other_sport | non_sport>\n"
    "Reason: <one short sentence>\n"
)

# Where label and reason are searched in answers that are no JSON.
LABEL_PATTERN = r'"label"\s*:\s*"([^"]+)"'
REASON_PATTERN = r'"reason"\s*:\s*"([^"]*)'

# Text columns of the two keyword filters, and their default caps.
TEXT_COLUMNS = ["title", "tags", "description", "channelTitle", "category_id", "country_code"]
GAMES_COLUMNS = ["title", "tags", "description", "channel_title"]
PER_COUNTRY = 200
OVERALL = 2000

# Columns of the answer tables, in order.
ANSWER_COLUMNS = [
    "index", "title", "tags", "description", "video_id", "country_code", "label", "reason", "raw_resp",
]

# Disjoint bins around an event; offsets in days, counted from
# the first event day ("start") or from the last one ("end").
EVENT_BINS = [
    ("Week −1", "start", -7, "start", -1),
    ("During", "start", 0, "end", 0),
    ("Week +1", "end", 1, "end", 7),
    ("Week +2", "end", 8, "end", 14),
    ("Week +3", "end", 15, "end", 21),
]
