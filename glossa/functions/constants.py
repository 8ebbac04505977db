"""Word lists, ladders and coefficients that results depend on, in natural order."""

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "no", "da", "pl", "cs")
#: Articles and the like that may stand, followed by white space, before a word.
STRIPPED = "the a an to der die das dem den des ein eine einen einem einer eines zu le la les l' un une des du el los las una unos unas il lo i gli uno un' o os as um uma uns umas de het een te en ei ett et det att å at się se si s' sich".split()
#: First words that a dictionary key drops.
LOOKUP_ARTICLES = "the a an to zu der die das den dem des ein eine einen einem eines einer le la les l un une du el los las una unos unas il lo i gli uno o os as um uma uns umas de het een te en ei ett et det att å at sich se si".split()
#: First words that a tolerant match of answers drops.
ANSWER_ARTICLES = "der die das ein eine le la les l' un une el los las il lo gli o a os as um uma de het een en ett".split()
#: Languages whose adjectives have no gendered pair.
ONE_FORM_ADJECTIVES = ("de", "nl", "sv", "no", "da", "pl", "cs", "en")
#: Endings of infinitives by language, on text without accents; other languages pass.
INFINITIVES = {"de": r"^(sich )?\S+(e?(n|rn|ln))$", "fr": r"(^se |^s'|^s’|(er|ir|re|oir|oire)$)", "es": r"(ar|er|ir|arse|erse|irse)$", "it": r"(are|ere|ire|rre|arsi|ersi|irsi)$", "pt": r"(ar|er|ir|or|ar-se|er-se|ir-se)$", "nl": r"(en|an|on|un|ijn)$", "en": r"^to "}
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿçñčšžřěůďťňąęśźżńć"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyycncszreudtnaeszznc"
#: Days until a card of box 1..5 is due.
DUE_DAYS = (1, 2, 4, 8, 16)
DAY_MS = 86_400_000
#: Coefficients and thresholds of the ordinal difficulty model.
W_ZIPF, W_AOA = -1.9267, 4.7804
THRESHOLDS = (-0.1559, 0.6753, 1.5918, 2.013, 2.6026)
BASIC_LIMIT, PRO_LIMIT, DAILY_QUOTA = 2000, 5000, 3
FALLBACK_TTL_MS, LIMITER_CALLS, LIMITER_MS, PER_MINUTE = 30 * DAY_MS, 10, 60_000, 120
#: Names of the languages in themselves and in English, and the countries of their flags.
NATIVE_NAMES = {"en": "English", "de": "Deutsch", "fr": "Français", "es": "Español", "it": "Italiano", "pt": "Português", "nl": "Nederlands", "sv": "Svenska", "no": "Norsk", "da": "Dansk", "pl": "Polski", "cs": "Čeština"}
ENGLISH_NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "no": "Norwegian", "da": "Danish", "pl": "Polish", "cs": "Czech"}
COUNTRIES = {"de": "DE", "en": "GB", "fr": "FR", "es": "ES", "it": "IT", "pt": "PT", "nl": "NL", "sv": "SE", "no": "NO", "da": "DK", "pl": "PL", "cs": "CZ"}
#: Families of the languages.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "no", "da"), "romance": ("fr", "es", "it", "pt"), "slavic": ("pl", "cs")}
#: Languages by their codes of three letters; both forms of Norwegian are one.
THREE_LETTERS = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "swe": "sv", "nob": "no", "nno": "no", "dan": "da", "pol": "pl", "ces": "cs"}
