"""Token expressions shared by the text operators; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes. Order matters, the first alternative that fits wins.
# A word character is a letter, a digit or the underscore, in any script.
CHAR = r"[\p{L}\p{N}_]"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
LINK = r"(?:https?://|ftp://|www\.)[^\s<>\"]+"
WORD = rf"{CHAR}+(?:['’-]{CHAR}+|[.,:/]\d+)*"
SYMBOL = r"[^\p{L}\p{N}_\s]"
TOKEN = f"({EMAIL}|{LINK}|{WORD}|{SYMBOL})"
NUMBER = r"\d+(?:[.,/:]\d+)*"

# Words that stand for numbers.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
    "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "trillion",
)


def tokenize(text: Column, symbols: bool = True) -> Column:
    """E-mail addresses, links and words stay whole; punctuation stands alone, or is left out without ``symbols``."""
    rest = f"{LINK}|{WORD}|{SYMBOL}" if symbols else f"{LINK}|{WORD}"
    # The same matches: no address without the sign, and what stands before it is never taken back.
    address = EMAIL.replace("+@", "++@", 1)
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(f"({address}|{rest})"), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(f"({rest})"), F.lit(1))
    )


# Most tokens are plain words: a look at single characters spares them the regular expressions.
def is_email(token: Column) -> Column:
    return token.contains("@") & token.rlike(f"^{EMAIL}$")


def is_link(token: Column) -> Column:
    start = F.lower(F.substring(token, 1, 4))
    return (token.contains(":") | token.contains(".")) & start.isin("http", "ftp:", "www.") & token.rlike(f"^{LINK}$")


def is_number(token: Column) -> Column:
    return (F.ascii(token).between(48, 57) & token.rlike(f"^{NUMBER}$")) | F.lower(token).isin(*NUMBER_WORDS)


def is_punctuation(token: Column) -> Column:
    return ~F.ascii(token).between(97, 122) & token.rlike(f"^{SYMBOL}+$")


def words(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({CHAR}{CHAR}+)"), F.lit(1))
