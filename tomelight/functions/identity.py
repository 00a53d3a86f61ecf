"""When two names mean one thing: people, titles, file names, and fuzzy scores, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, let

#: Words that are no part of a person's name, and words that belong to the surname after them.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "dr", "mr", "mrs", "ms")
PARTICLES = ("de", "del", "della", "der", "den", "di", "da", "du", "la", "le", "van", "von", "ten", "ter")
#: Leading words of titles that don't count, words that a volume's number follows, numbers as words.
ARTICLES = ("the", "a", "an")
KEYWORDS = ("book", "bk", "vol", "volume", "part", "pt", "episode", "ep", "chapter", "issue", "season", "no", "number", "#")
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
#: The keywords after which a number is written in figures only, and those that a comic's issue follows.
FIGURES_ONLY = ("no", "number", "#")
ISSUES = ("#", "issue", "no", "number", "episode", "ep", "chapter")
#: Words that a remark on an edition or format is made of.
DESCRIPTORS = (
    "edition ed anniversary illustrated annotated unabridged abridged complete uncut deluxe special collectors collector expanded revised extended updated definitive enhanced remastered digital retail "
    "ebook audiobook audio full cast production dramatized dramatised dramatization dramatisation version original scan first second third fourth fifth sixth seventh eighth ninth tenth "
    "twentieth thirtieth fortieth fiftieth sixtieth seventieth hundredth twenty thirty forty fifty sixty seventy hundred and the a an "
    "pdf epub mobi azw azw3 fb2 cbz cbr cb7 m4b m4a mp3 opus kindle"
).split()
#: Words one of which makes such a remark one.
ANCHORS = (
    "edition ed anniversary illustrated annotated unabridged abridged uncut deluxe expanded revised remastered digital retail ebook audiobook audio dramatized dramatised dramatization dramatisation production scan "
    "pdf epub mobi azw azw3 fb2 cbz cbr cb7 m4b m4a mp3 opus kindle"
).split()
#: Anchors that are one next to a title even alone, and those that may lead a name.
STANDALONE = "unabridged abridged uncut ebook audiobook dramatized dramatised illustrated annotated pdf epub mobi azw azw3 fb2 cbz cbr cb7 m4b m4a mp3".split()
LEADING = "unabridged abridged ebook audiobook dramatized dramatised pdf epub mobi azw azw3 fb2 cbz cbr cb7 m4b m4a mp3".split()
_ORDINAL = r"\d+(?:st|nd|rd|th)"


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def person(name: Column) -> Column:
    """A name as struct(surname, given): "Last, First M." or "First M. Last"; null without a surname of two letters."""

    def words(text: Column) -> Column:
        return F.filter(F.split(F.trim(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), lambda w: (w != "") & ~F.array_contains(_texts(SUFFIXES), w))

    def made(last: Column, first: Column) -> Column:
        # particles at the end of the given names belong to the surname
        kept = F.aggregate(F.reverse(first), F.array().cast("array<string>"), lambda out, w: F.when((F.size(out) == 0) & F.array_contains(_texts(PARTICLES), w), out).otherwise(F.concat(out, F.array(w))))
        return let(last, lambda x: F.when(F.length(x) >= 2, F.struct(x.alias("surname"), F.reverse(kept).alias("given"))))

    plain = F.regexp_replace(folded(name), "['\u2019\u02bc`]", "")
    parts = F.split(plain, ",")
    turned = let(parts, lambda p: made(F.try_element_at(words(F.element_at(p, 1)), F.lit(-1)), words(F.element_at(p, 2))))
    straight = let(words(plain), lambda w: made(F.try_element_at(w, F.lit(-1)), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))))
    return F.when(name.rlike("^[^,]*,[^,]*$"), turned).otherwise(straight)


def strength(a: Column, b: Column) -> Column:
    """How well two persons agree: 2 equal surnames and given names that are equal or initials of each other as far as both go,
    1 equal surnames and no given name on one side, else 0."""

    def agreed(a: Column, b: Column) -> Column:
        both = F.least(F.size(a["given"]), F.size(b["given"]))
        pairs = F.zip_with(F.slice(a["given"], 1, both), F.slice(b["given"], 1, both), lambda x, y: (x == y) | ((F.length(x) == 1) & y.startswith(x)) | ((F.length(y) == 1) & x.startswith(y)))
        agree = F.when(both == 0, 1).when(F.forall(pairs, lambda p: p), 2).otherwise(0)
        return F.coalesce(F.when(a["surname"] == b["surname"], agree), F.lit(0))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: agreed(p["a"], p["b"]))


def best_strength(a: Column, b: Column) -> Column:
    """The best agreement between any person of one array and any of the other."""
    return F.aggregate(a, F.lit(0), lambda best, x: F.greatest(best, F.aggregate(b, F.lit(0), lambda most, y: F.greatest(most, strength(x, y)))))


def base_name(file: Column) -> Column:
    """A file name without its extension."""
    return F.regexp_replace(file, r"(?<=.)\.[A-Za-z0-9]{1,5}$", "")


def _roman(word: Column) -> Column:
    """Value of a Roman numeral from i to xxxix, else null."""
    return F.when(word.rlike("^[ivx]+$"), _roman_value(word))


def _roman_value(word: Column) -> Column:
    ones = F.create_map(*[F.lit(x) for pair in (("", 0), ("i", 1), ("ii", 2), ("iii", 3), ("iv", 4), ("v", 5), ("vi", 6), ("vii", 7), ("viii", 8), ("ix", 9)) for x in pair])
    tens = F.length(F.regexp_extract(word, "^(x{0,3})", 1))
    value = tens * 10 + F.try_element_at(ones, F.regexp_replace(word, "^x{0,3}", ""))
    return F.when(value > 0, value)


def title_identity(name: Column, comic: Column | None = None) -> Column:
    """struct(identity, copy, years, without_copy) of a title or of a file name without extension.

    identity: folded words without articles; numbers after a keyword (book, vol, #, ...), ordinals, "v01" and Roman numerals of two
    letters or more as figures. Remarks on an edition are left out: in brackets or as a part of their own where all their words are
    such words and one is an anchor, at the end of a name where one is an anchor that stands alone or two words are
    of them, at its beginning where a leading anchor is among them. copy: the number of a copy mark (" (1)", " - Copy"), which
    without a copy to fold into reads as a number. years: four figures in brackets. comic: whether the name is a comic's: its
    numbers but for those of volumes are issues ("i7"), and a deluxe edition is another book.
    """
    return let(folded(name), lambda text: _identity(text, F.lit(False) if comic is None else F.coalesce(comic, F.lit(False))))


def _remark(text: Column, comic: Column) -> Column:
    """Whether all words of a text are descriptors and one is an anchor."""

    def matched(words: list[str], anchors: list[str]) -> Column:
        word, apart = "(?:" + "|".join([*words, _ORDINAL]) + ")", r"[^\p{L}\p{N}]"
        return text.rlike(rf"^{apart}*{word}(?:{apart}+{word})*{apart}*$") & text.rlike(rf"(?:^|{apart})(?:{'|'.join(anchors)})(?:{apart}|$)")

    plain = [w for w in DESCRIPTORS if w != "deluxe"]
    return F.when(comic, matched(plain, [a for a in ANCHORS if a != "deluxe"])).otherwise(matched(DESCRIPTORS, ANCHORS))


def _without_runs(words: Column, comic: Column) -> Column:
    """Words without the descriptors that end or begin them, if these make a remark; one word always stays."""
    descriptor = lambda w: (w.isin(*DESCRIPTORS) | w.rlike(f"^{_ORDINAL}$")) & ~(comic & (w == "deluxe"))
    among = lambda run, known: F.exists(run, lambda w: w.isin(*known))

    def run_length(words: Column) -> Column:
        """Number of descriptors that an array begins with, one less if that is all of it."""
        begun = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
        n = F.aggregate(words, begun, lambda s, w: F.struct((s["on"] & descriptor(w)).alias("on"), (s["n"] + F.when(s["on"] & descriptor(w), 1).otherwise(0)).alias("n")), lambda s: s["n"])
        return F.greatest(F.lit(0), F.least(n, F.size(words) - 1))

    def ended(words: Column) -> Column:
        def cut(n: Column) -> Column:
            run = F.slice(words, F.size(words) - n + 1, n)
            counted = F.size(F.filter(run, lambda w: ~w.isin(*ARTICLES, "and")))
            remark = (n > 0) & among(run, ANCHORS) & (among(run, STANDALONE) | (counted >= 2))
            return F.when(remark, F.slice(words, 1, F.size(words) - n)).otherwise(words)

        return let(run_length(F.reverse(words)), cut)

    def begun(words: Column) -> Column:
        def cut(n: Column) -> Column:
            return F.when((n > 0) & among(F.slice(words, 1, n), LEADING), F.slice(words, n + 1, F.size(words) - n)).otherwise(words)

        return let(run_length(words), cut)

    either = F.coalesce(descriptor(F.try_element_at(words, F.lit(-1))) | descriptor(F.try_element_at(words, F.lit(1))), F.lit(False))
    return F.when(either, let(let(words, ended), begun)).otherwise(words)


def _identity(text: Column, comic: Column) -> Column:
    text = F.replace(text, F.lit("_"), F.lit(" "))
    marked = F.regexp_extract(text, r"\s\(([1-9]\d?)\)$", 1)
    copied = text.rlike(r"\s-\scopy(\s\(\d+\))?$")
    copy = F.when(copied, 1).when(marked != "", marked.cast("int"))
    bare = F.regexp_replace(text, r"\s(-\scopy(\s\(\d+\))?|\([1-9]\d?\))$", "")
    years = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\(\[]((?:1[5-9]|20)\d\d)[\)\]]"), F.lit(1))))
    plain = F.regexp_replace(bare, r"[\(\[](?:1[5-9]|20)\d\d[\)\]]", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\baudio[\s-]book\b", "audiobook"), r"\be[\s-]book\b", "ebook")
    # brackets: a remark or a release's tag goes, what else stands in them stays as words
    pieces = F.regexp_extract_all(plain, F.lit(r"[\(\[{][^\(\)\[\]{}]*[\)\]}]|[^\(\[{]+|[\(\[{]"), F.lit(0))
    bracket = lambda p: p.rlike(r"^[\(\[{].*[\)\]}]$") & (_remark(p, comic) | p.rlike(r"^.\s*v\d+(\.\d+)*\s*.$"))
    kept = F.array_join(F.transform(pieces, lambda p: F.when(bracket(p), F.lit(" ")).otherwise(p)), "")
    parts = F.filter(F.split(kept, r"\s+[-\u2013\u2014]\s+|\s*:\s+"), lambda p: F.trim(p) != "")
    good = lambda ps: let(F.filter(ps, lambda p: ~_remark(p, comic)), lambda g: F.when(F.size(g) > 0, g).otherwise(ps))
    some = let(parts, lambda ps: F.when(F.size(ps) > 1, good(ps)).otherwise(ps))
    spaced = F.replace(F.replace(F.array_join(some, " "), F.lit("#"), F.lit(" # ")), F.lit("&"), F.lit(" and "))
    words = F.filter(F.split(F.regexp_replace(spaced, "['\u2018\u2019`]", ""), r"[^\p{L}\p{N}#]+"), lambda w: w != "")
    named = F.create_map(*[F.lit(x) for known in (NUMBERS, ORDINALS) for i, w in enumerate(known) for x in (w, i + 1)], F.lit("zero"), F.lit(0))

    def numbered(words: Column) -> Column:
        """Each word with the figures that it stands for, if it does; a comic's issue with an i before them."""

        def number(w: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            known = lambda keys: (i > 0) & F.coalesce(before.isin(*keys), F.lit(False))
            after = known(KEYWORDS)
            spelled = known([k for k in KEYWORDS if k not in FIGURES_ONLY])
            release = w.rlike(r"^v\d+$")
            digits = F.when(w.rlike(r"\d") & w.rlike(rf"^(?:v?\d+|{_ORDINAL})$"), F.regexp_replace(F.regexp_extract(w, r"(\d+)", 1), r"^0+(?=\d)", ""))
            counted = F.when(spelled | (F.length(w) >= 2), _roman(w)).cast("string")
            n = F.coalesce(digits, counted, F.when(spelled, F.try_element_at(named, w)).cast("string"))
            issue = comic & ~release & (~after | known(ISSUES))
            return F.struct(w.alias("w"), F.when(issue, F.concat(F.lit("i"), n)).otherwise(n).alias("n"))

        return F.transform(words, number)

    def joined(read: Column) -> Column:
        """Figures in place of their words, without articles and the keywords before figures."""

        def stays(x: Column, i: Column) -> Column:
            leads = F.coalesce(x["w"].isin(*KEYWORDS) & F.get(read, i + 1)["n"].isNotNull(), F.lit(False))
            return ~leads & (x["n"].isNotNull() | ~x["w"].isin(*ARTICLES))

        return F.array_join(F.transform(F.filter(read, stays), lambda x: F.coalesce(x["n"], x["w"])), " ")

    def made(without: Column) -> Column:
        number = F.when(comic, F.concat(F.lit("i"), copy.cast("string"))).otherwise(copy.cast("string"))
        identity = F.when(copy.isNotNull(), F.concat(without, F.lit(" "), number)).otherwise(without)
        return F.struct(identity.alias("identity"), copy.alias("copy"), years.alias("years"), without.alias("without_copy"))

    stripped = let(words, lambda w: _without_runs(w, comic))
    return let(let(stripped, lambda w: let(numbered(w), joined)), made)


def fuzzy_score(term: Column, query: Column) -> Column:
    """One point for each letter of ``query`` found in ``term`` in order, two more where it follows the letter found before."""
    start = F.struct(F.lit(0).alias("at"), F.lit(-9).alias("before"), F.lit(0).alias("score"))

    def moved(s: Column, place: Column) -> Column:
        found = place > 0
        gained = F.when(s["before"] + 1 == place, 3).otherwise(1)
        return F.struct(F.when(found, place).otherwise(F.length(term)).alias("at"), F.when(found, place).otherwise(s["before"]).alias("before"), (s["score"] + F.when(found, gained).otherwise(0)).alias("score"))

    def step(s: Column, letter: Column) -> Column:
        return let(F.call_function("locate", letter, term, s["at"] + 1), lambda place: moved(s, place))

    return F.aggregate(F.filter(F.split(query, ""), lambda c: c != ""), start, step, lambda s: s["score"])


def fuzzy_ratio(a: Column, b: Column, score: Column | None = None) -> Column:
    """Fuzzy score of two lower-cased words (given, or computed here) over the better of their scores with themselves.

    A word finds itself letter by letter: one point for the first and three for every other.
    """
    x, y = F.lower(a), F.lower(b)
    most = F.greatest(F.length(x), F.length(y)) * 3 - 2
    return F.when(most > 0, (fuzzy_score(x, y) if score is None else score) / most).otherwise(0.0)


def score_card(signals: list[tuple[Column, int, bool]], mark: int = 70, review: int = 40) -> tuple[Column, Column]:
    """(score, verdict) of additive evidence: (condition, points, decisive). A decisive signal that holds ends the count."""
    decided = F.lit(None).cast("int")
    for condition, points, decisive in reversed(signals):
        if decisive:
            decided = F.when(F.coalesce(condition, F.lit(False)), points).otherwise(decided)
    total = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p, d in signals if not d), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(decided, total)))
    return score, F.when(score >= mark, "COMIC").when(score >= review, "BORDERLINE").otherwise("NOT_COMIC")
