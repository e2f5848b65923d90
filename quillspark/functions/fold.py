"""Unicode composition (NFC), for which Spark has no function of its own: ICU's, which Spark brings along, is called in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only texts with a mark, a Hangul letter or a sign that has another canonical form can change.
MAY_CHANGE = r"[\p{M}\x{1100}-\x{11FF}\x{0340}-\x{0343}\x{0374}\x{037E}\x{0387}\x{1F00}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{2F800}-\x{2FA1F}]"


def composed(text: Column) -> Column:
    """Text in NFC; null stays null. Texts that are composed already are not looked at by ICU."""
    icu = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(MAY_CHANGE), icu).otherwise(text)
