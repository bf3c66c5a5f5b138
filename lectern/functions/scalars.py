"""Column functions: time marks, text cleaning, clipping, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """Seconds as m:ss or h:mm:ss; truncated, negative as 0."""
    s = F.greatest(F.lit(0).cast("long"), seconds.cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(seconds.isNull(), None).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def parse_clock(text: Column) -> Column:
    """Seconds of m:ss, h:mm:ss or plain seconds, with [ ] @ around and a decimal comma allowed; else null."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\[\]@\s]", ""), ",", ".")
    parts = F.split(t, ":")
    ok = t.rlike(r"^\d+(:\d+){0,2}(\.\d+)?$")
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double")))


def parse_range(text: Column) -> Column:
    """struct(start, end) seconds of "a-b" with any dash; an end of "end" is open (null); null if it isn't a range."""
    a = parse_clock(F.regexp_extract(text, r"^\s*([^-–—]+)[-–—]", 1))
    tail = F.trim(F.regexp_extract(text, r"^[^-–—]+[-–—](.*)$", 1))
    b = parse_clock(tail)
    open_end = F.lower(tail).isin("end", "конец")
    return F.when(a.isNotNull() & (open_end | (b > a)), F.struct(a.alias("start"), b.alias("end")))


def seek_marks(text: Column) -> Column:
    """[1:00–1:20] as @1:00-1:20."""
    return F.regexp_replace(text, r"\[(\d+(?::\d{2}){1,2})\s*[–—-]\s*(\d+(?::\d{2}){1,2})\]", "@$1-$2")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip(text: Column, n: int) -> Column:
    """Squeezed, and cut to n - 1 characters and an ellipsis where longer than n."""
    t = squeezed(text)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def clip_words(text: Column, n: int) -> Column:
    """At most n characters, cut at the last space among them if there is one."""
    cut = F.substring(text, 1, n)
    at_space = F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(text) <= n, text).when(at_space != "", at_space).otherwise(cut)


def flag(text: Column, default: Column) -> Column:
    """A word that means yes or no as a boolean; ``default`` for any other, and for null."""
    word = F.lower(squeezed(text))
    return F.when(word.isin("true", "да", "yes", "1"), True).when(word.isin("false", "нет", "no", "0"), False).otherwise(default)


def deep_link(url: Column, seconds: Column) -> Column:
    """A YouTube address with the query t=<s>s in place of any t it had; other addresses as they are."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^@/?#]*@)?([^:/?#]+)", 1)), r"^www\.", "")
    youtube = host.isin("youtu.be", "youtube.com", "youtube-nocookie.com") | host.rlike(r"\.youtube(-nocookie)?\.com$")
    part = lambda k: F.regexp_extract(url, r"^([^?#]*)(\?[^#]*)?(#.*)?$", k)
    query = F.substring(part(2), 2, 1 << 30)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^t(=|$)"))
    mark = F.concat(F.lit("t="), F.greatest(F.lit(0).cast("long"), F.floor(seconds)).cast("string"), F.lit("s"))
    first = F.array_position(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: x.rlike("^t(=|$)")), True)
    before = F.when(first > 0, first - 1).otherwise(F.size(kept)).cast("int")
    listed = F.concat(F.slice(kept, F.lit(1), before), F.array(mark), F.slice(kept, before + 1, F.size(kept)))
    base = F.when(part(1).rlike(r"^[^/]+//[^/]+$"), F.concat(part(1), F.lit("/"))).otherwise(part(1))
    return F.when(youtube, F.concat(base, F.lit("?"), F.array_join(listed, "&"), part(3))).otherwise(url)


def yes_no(text: Column) -> Column:
    """True or false by the first of ДА, YES, НЕТ, NO as a word; null without one."""
    word = F.try_element_at(F.regexp_extract_all(F.upper(text), F.lit(r"(?U)\b(ДА|YES|НЕТ|NO)\b"), F.lit(1)), F.lit(1))
    return F.when(word.isin("ДА", "YES"), True).when(word.isin("НЕТ", "NO"), False)


def human_bytes(n: Column) -> Column:
    """Bytes in Б, КБ, МБ, ГБ; one decimal with a comma under 10."""
    v, unit = n.cast("double"), F.lit("Б")
    for k, name in ((1, "КБ"), (2, "МБ"), (3, "ГБ")):
        big = n >= 1024**k
        v, unit = F.when(big, n / float(1024**k)).otherwise(v), F.when(big, F.lit(name)).otherwise(unit)
    whole = (unit == "Б") | (v >= 10)
    return F.concat(F.when(whole, F.round(v).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.1f", v), r"\.", ",")), F.lit(" "), unit)


def speaker_hue(label: Column) -> Column:
    """A hue of 0..359 for a label: h = (33 h + code) mod 360 over its characters."""
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda h, c: ((h * 33 + F.ascii(c)) % 360).cast("int"))


def version_key(version: Column) -> Column:
    """The numbers of a dotted or dashed version, for comparing: of each piece its digits, of any length up to 38 (more count as the
    greatest number); pieces without digits don't count."""
    pieces = F.filter(F.transform(F.split(version, r"[.-]"), lambda x: F.regexp_replace(x, r"[^0-9]", "")), lambda x: x != "")
    return F.transform(pieces, lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")))


# fixed values: marks of the text format and what stands for them, in the order in which they are taken away
MARKDOWN = (
    (r"\r\n", "\n"),  # line ends
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),  # links
    (r"`([^`]+)`", "$1"),  # code
    (r"(?s)\*\*(.+?)\*\*", "$1"),  # bold
    (r"(?s)__(.+?)__", "$1"),  # underlined
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),  # headings
    (r"(?m)^\s*[-*+]\s+", ""),  # bullets
    (r"(?<!\*)\*(?!\s)([^*\n]+?)\*(?!\*)", "$1"),  # italics
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)


def plain_text(text: Column) -> Column:
    """Without markdown, blank lines collapsed, no white space at the ends."""
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def for_speech(text: Column, most: int = 4000) -> Column:
    """Without time marks and marks of markup, squeezed, cut."""
    t = F.regexp_replace(text, r"\[?@?\d+(:\d{2}){1,2}\s*[–—-]\s*@?\d+(:\d{2}){1,2}\]?", " ")
    return F.substring(squeezed(F.regexp_replace(t, r"[*_`#>|\[\]{}]", " ")), 1, most)


def sentence_closed(text: Column) -> Column:
    """Ends in . ! ? … with closing marks allowed after it."""
    return F.rtrim(text).rlike(r"[.!?…][\"'»”)\]]*$")


# fixed values: abbreviations that end in a point and no sentence, and marks that may close one
ABBREVIATIONS = ("т.д.", "т.п.", "т.е.", "т.к.", "т.н.", "т.о.", "др.", "пр.", "см.", "рис.", "табл.", "им.", "ул.", "стр.", "г.", "гг.")
CLOSERS = "\"'»)]}”"


def ends_sentence(token: Column) -> Column:
    """Does a word end a sentence: a mark . ! ? …, closing marks allowed after it; not an abbreviation, nor an initial."""
    core = F.regexp_replace(F.trim(token), r"[\"'»)\]}”]+$", "")
    return core.rlike(r"[.!?…]$") & ~F.lower(F.regexp_replace(core, " ", "")).isin(*ABBREVIATIONS) & ~core.rlike(r"^[A-Za-zА-Яа-яЁё]\.$")


def query_terms(text: Column, most: int = 4) -> Column:
    """The first words of four or more letters or digits, distinct without regard to case, in their first form."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)([\p{L}\p{N}]{4,})"), F.lit(1))
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))
    return F.slice(kept, 1, most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; -1 where the lengths differ."""
    return F.when(F.size(a) != F.size(b), F.lit(-1.0)).otherwise(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def once(value: Column, to: Callable[[Column], Column]) -> Column:
    """to(value) with the value computed once a row, however often ``to`` uses it, also for each element of an array."""
    return F.element_at(F.transform(F.array(value), lambda x: to(x)), 1)


def unit(v: Column, least: float = 1e-8) -> Column:
    """The vector at length 1; null if it is shorter than ``least``."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return once(v, lambda v: once(norm(v), lambda n: F.when(n >= least, F.transform(v, lambda x: x.cast("double") / n))))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors (array of arrays) whose mask is 1, at length 1; null without any."""
    kept = F.transform(F.filter(F.zip_with(tokens, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m"))), lambda x: x["m"] == 1), lambda x: x["t"])
    total = lambda kept: F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.transform(F.try_element_at(kept, F.lit(1)), lambda x: x.cast("double")), lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    mean = lambda kept: once(F.size(kept), lambda n: F.transform(total(kept), lambda x: x / n))
    return once(kept, lambda kept: F.when(F.size(kept) > 0, unit(mean(kept))))


def vec_to_text(v: Column) -> Column:
    """[x,y,…] with seven places, halves to the even digit; what is rounded to zero keeps its sign."""
    sign = lambda x: F.when((F.abs(x) <= 5e-8) & x.cast("string").startswith("-"), "-").otherwise("")
    told = lambda x: F.concat(sign(x), F.format_string("%.7f", F.bround(x, 7)))
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: told(x.cast("double"))), ","), F.lit("]"))


def text_to_vec(t: Column) -> Column:
    return F.from_json(t, "array<double>")
