"""Results are only right when these match exactly."""

# Month labels; index 0 is a blank label on purpose.
MONTH_LABELS = (
    "", "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

# Words and characters that mark a text as Spanish.
SPANISH_WORDS = (
    "el", "la", "los", "las", "un", "una", "unos", "unas",
    "de", "del", "en", "con", "por", "para", "sobre", "entre",
    "que", "como", "donde", "cuando", "quien",
    "es", "son", "fue", "fueron", "está", "están",
    "muy", "más", "también", "además", "durante",
)
SPANISH_CHARACTERS = "áéíóúñ¿¡"
SPANISH_SHARE = 0.1

# Spanish language names and their English names.
LANGUAGE_NAMES = {
    "inglés": "English",
    "español": "Spanish",
    "francés": "French",
    "alemán": "German",
    "italiano": "Italian",
    "portugués": "Portuguese",
    "chino": "Chinese",
    "japonés": "Japanese",
    "coreano": "Korean",
    "árabe": "Arabic",
    "ruso": "Russian",
    "hindi": "Hindi",
}

# The characters Python's str.strip() and str.split() treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Limits, defaults and accepted link prefixes.
OUTPUT_LANGUAGES = ("en", "es")
SAFE_LINK_PREFIXES = ("http://", "https://", "mailto:")
MIN_BULLET_LENGTH = 10
MAX_MESSAGE_LENGTH = 500
MAX_ARCHIVE_BYTES = 500 * 1024 * 1024
# What a file source can hold in one row; larger files become issues.
READABLE_BYTES = 2_147_483_632
