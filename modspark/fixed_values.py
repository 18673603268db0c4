"""Values that results depend on.

Every list and table here is a fixed value: it has to equal what existing users
of these rules already run with, so that outputs stay comparable.
"""

# --- fixed values: Unicode blocks, in tie-break order -----------------------
SCRIPT_BLOCKS = [
    ("devanagari", "\\u0900-\\u097F", "hi"),
    ("bengali", "\\u0980-\\u09FF", "bn"),
    ("tamil", "\\u0B80-\\u0BFF", "ta"),
    ("telugu", "\\u0C00-\\u0C7F", "te"),
    ("kannada", "\\u0C80-\\u0CFF", "kn"),
    ("malayalam", "\\u0D00-\\u0D7F", "ml"),
    ("gujarati", "\\u0A80-\\u0AFF", "gu"),
    ("gurmukhi", "\\u0A00-\\u0A7F", "pa"),
    ("odia", "\\u0B00-\\u0B7F", "or"),
]
LATIN_SHARE_MIXED = 0.2
DEVANAGARI_SHARE = 0.3

INDIAN_CODES = ["hi", "hi-en", "bn", "ta", "te", "kn", "ml", "gu", "pa", "or", "indic-en"]

# --- fixed values: romanised Hindi indicator words --------------------------
ROMANISED_HINDI = """
kya hai hain nahi nhi mat aur bhi toh
mein main tera mera tumhara hamara apna
yeh woh koi kuch sab bahut bohot
karo karna bolo bolna jao jana aao aana
dekho dekhna suno sunna chalo ruk ruko
yaar bhai arre abey oye chal
accha theek sahi galat bakwas pagal
bewakoof gadha ullu kamina kamini harami
chutiya madarchod behenchod bhosdike gaandu
saala saali kutte kuttia haramkhor
""".split()

# --- fixed values: look-alike letters, Cyrillic -> Latin ---------------------
HOMOGLYPH_FROM = "аеіорсухЬАВЕКМНОРСТХ"
HOMOGLYPH_TO = "aeiopcyxbABEKMHOPCTX"

# --- fixed values: digit and symbol letters ---------------------------------
LEET_DIGITS_FROM = "0134578"
LEET_DIGITS_TO = "oieastb"
LEET_SYMBOLS = [("@", "a"), ("$", "s"), ("!", "i")]

# --- fixed values: characters removed by text cleaning -----------------------
INVISIBLE = "\\u200b-\\u200f\\u2028-\\u202f\\u2060-\\u2069\\ufeff"

# --- fixed values: rewrite rules in order (words, replacement, whole words?) ---
SCRUB_RULES = [
    ("bewakoof|gadhha|gadhe|chutiya|chomu|ullu|lukkha|nalayak", "naasamajh", True),
    ("saale|saala|kamine|kamini|harami|haramkhor|dalla|suar|kutta|kutte|bhikari", "", True),
    ("bhenchod|madarchod|machod|boshdike|bsdk|mc|bc", "bhai", True),
    ("bakwas mat kar|bakwas band kar|faltu baat band kar", "sahi se baat karo", True),
    (
        "muh tod duga|maar duga|jawani nikal dunga|aukat me reh|aukat dekh|aukat",
        "shanti aur hadd me raho",
        True,
    ),
    ("nikal yahan se|nikal pehli fursat mein", "kripya abhi yahan se jao", True),
    ("बेवकूफ|गधा|चूतिया|हरामी|नालायक|कमीने|सूअर|कुत्ता", "नासमझ", False),
    ("साले|साला|हरामखोर|भिखारी", "", False),
    ("बहनचोद|मादरचोद", "भाई", False),
    ("बकवास मत कर|बकवास बंद कर", "सही से बात करो", False),
    ("मुंह तोड़ दूंगा|मार दूंगा|औकात में रह", "शांति से बात करो", False),
    (
        "idiot|moron|retard|retarded|fool|clown|freak|loser|parasite|scum|trash|bastard",
        "mistaken",
        True,
    ),
    ("shut up", "please stop talking", True),
    ("go to hell", "please leave this conversation", True),
    ("fucking|fuck|bitch|shit|asshole|damn", "", True),
]

# --- fixed values: plain word removal for corpus pairs -------------------------
PLAIN_SCRUB_WORDS = "idiot moron stupid bitch fuck fucking shit asshole bastard".split()
PLAIN_SCRUB_DEFAULT = "I strongly disagree with your approach on this topic."
PLAIN_SCRUB_MAX_CHARS = 110

# --- fixed values: phrases that mark a generic reply ---------------------------
GENERIC_REPLY_PHRASES = [
    "kripya",
    "respectful",
    "vinaamrata",
    "sabhyata",
    "apashabd",
    "bhasha",
    "polite",
    "language",
    "maintain",
    "baat karte hain",
    "samvad",
    "opinion respectfully",
    "avoid using offensive",
    "offensive language",
]

# --- fixed values: replies by language when no rewrite is available ------------
REPLY_TEMPLATES = {
    "en": "Let's keep the conversation respectful.",
    "hi": "कृपया बातचीत को सम्मानजनक बनाए रखें।",
    "hi-en": "Yaar, thoda respectfully baat karte hain.",
    "bn": "দয়া করে কথোপকথনটি সম্মানজনক রাখুন।",
    "ta": "தயவுசெய்து உரையாடலை மரியாதையாக வைத்திருங்கள்.",
    "te": "దయచేసి సంభాషణను గౌరవంగా ఉంచండి.",
    "kn": "ದಯವಿಟ್ಟು ಸಂಭಾಷಣೆಯನ್ನು ಗೌರವಯುತವಾಗಿ ಇರಿಸಿ.",
    "ml": "ദയവായി സംഭാഷണം മാന്യമായി നിലനിർത്തുക.",
    "gu": "કૃપા કરી વાતચીતને સન્માનજનક રાખો.",
    "pa": "ਕਿਰਪਾ ਕਰਕੇ ਗੱਲਬਾਤ ਨੂੰ ਸਤਿਕਾਰਯੋਗ ਰੱਖੋ.",
    "indic-en": "Let's keep the conversation respectful, please.",
}

# --- fixed values: language display names ---------------------------------------
LANGUAGE_NAMES = {
    "en": "English",
    "hi": "Hindi (Devanagari)",
    "hi-en": "Hinglish (Hindi-English code-mixed)",
    "bn": "Bengali",
    "ta": "Tamil",
    "te": "Telugu",
    "kn": "Kannada",
    "ml": "Malayalam",
    "gu": "Gujarati",
    "pa": "Punjabi",
    "or": "Odia",
    "indic-en": "Indian language mixed with English",
}

SEVERITY_NAMES = {0: "Safe", 1: "Low", 2: "Medium", 3: "High"}

# --- fixed values: training prompt shape and completion marker ------------------
TRAINING_PROMPT_HEAD = "Rewrite this toxic text politely without any abuse:"
COMPLETION_MARKER = "Clean:"
EMPTY_COMPLETION = "(Empty generation)"
