"""Column helpers for dates: forced and guessed parsing, ISO weeks."""

from pyspark.sql import Column, functions as F

# (shape of the text, Java pattern); month first when the order is ambiguous.
MONTH_FIRST = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$", "d MMM yyyy"),
)
DAY_FIRST = MONTH_FIRST[:4] + MONTH_FIRST[6:8] + MONTH_FIRST[4:6] + MONTH_FIRST[8:]
STRFTIME = (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%H", "HH"), ("%M", "mm"),
            ("%S", "ss"), ("%b", "MMM"), ("%y", "yy"))


def java_pattern(fmt: str) -> str:
    for a, b in STRFTIME:
        fmt = fmt.replace(a, b)
    return fmt


def parse_date(c: Column, fmt: str | None = None, dayfirst: bool = False) -> Column:
    """Text to timestamp by a strftime format, or by the first listed format that fits."""
    text = F.trim(c.cast("string"))
    if fmt is not None:
        return F.try_to_timestamp(text, F.lit(java_pattern(fmt)))
    formats = DAY_FIRST if dayfirst else MONTH_FIRST
    parsed = F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
                          for shape, pattern in formats])
    # every listed format has 8 to 19 characters and starts with a digit: most text stops here
    return F.when(F.length(text).between(8, 19) & F.substring(text, 1, 1).between("0", "9"), parsed)


def week_start(c: Column) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", c))


def iso_year(c: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), c).cast("int")


def iso_week(c: Column) -> Column:
    return F.weekofyear(c)


def monday_of(year: Column, week: Column) -> Column:
    """Monday of an (ISO year, ISO week) pair."""
    first = week_start(F.make_date(year, F.lit(1), F.lit(4)))
    return F.date_add(first, ((week - 1) * 7).cast("int"))
