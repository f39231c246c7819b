"""Template residue and error-page text in articles with typesetting markup, by aligning records that follow one template.

Each text is brought to its printed form (comments, disabled blocks, verbatim, quoted phrases, formulas, macro definitions and
include commands are not printed text) and cut into units: the arguments of title, author and headings, and the clauses of every
line. Numbers, ids, paths and what stands in parentheses of one word are alike in all units. Three inductions over all records:

- Slots that retain a variable name. Units of different records are aligned where they hold the name of a field of a paper; the
  rest of the unit is a frame. A frame with NAMES different field names in as many records, which stands as a whole unit somewhere,
  is a template with a slot, and each place that fits it holds an unfilled slot, also in the middle of a line.
- Slots that retain a default. A value of a title or author slot in two papers that also fills another slot or stands as a unit of its own,
  in PAPERS papers altogether, is a default (words of an article stand in one of these places only); so is a short value of a slot that
  holds the slot's own name, in as many papers. Blanks are empty values and are no residue by the data's definition.
- Repeated whole pages. A page is a record without any markup. A unit is an error template if it stands on pages of which a third is
  made of units that other pages repeat, and such pages are a good part of all papers that hold it (half of at least 2, or a quarter of at
  least 3): sentences of articles that happen to repeat stand on pages only by chance.

The fixed values that follow are public knowledge about templates, none of the phrases of a given table: names of a paper's fields,
delimiters of template languages, HTTP status lines and pages, the words of the usual Latin filler, keys hit at random.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasm.session import broadcast_if_small

#: Different field names, and records, with which a frame counts as a template; papers with which a slot's value counts as a default.
NAMES, PAPERS = 3, 3
#: Tokens on either side of a field name within a clause where a frame is also looked for (a whole unit may have any length).
CONTEXT = 8

# Names of the fields of a paper; words may be joined by a space, _ or - or run together.
FIELDS = ["paper title", "short title", "section title", "title", "author name", "authors?", "abstract", "keywords?", "affiliations?", "doi", "journal name", "journal", "pub date", "publication date", "contact email", "e-?mail", "acknowledge?ments?", "funding"]
NAME = "(?:" + "|".join(f.replace(" ", "[ _-]?") for f in FIELDS) + ")"
FIELD = re.compile(rf"(?<![\w\\])(?:paper\.|doc\.)?({NAME})(?![\w])", re.I)
FIELD_US = re.compile(rf"(?<=__)(?:paper\.|doc\.)?({NAME})(?=__)", re.I)
# Delimiters of slots in template languages.
DELIMITERS = [("{{", "}}"), ("[[", "]]"), ("<<", ">>"), ("(((", ")))"), ("~~", "~~"), ("@@", "@@"), ("__", "__"), ("#", "#"), ("&lt;", "&gt;"), ("[$", "]"), ("${", "}"), ("{%", "%}"), ("<%=", "%>"), ("<%", "%>"), ("%%", "%%")]
_ID = r"\s*(?:\w+\.)?" + NAME + r"\s*"
SLOT = re.compile("|".join(re.escape(a) + _ID + re.escape(b) for a, b in DELIMITERS), re.I)
#: Slots whose delimiters would be taken for a comment or a formula.
PROTECT = re.compile(rf"\{{%({_ID})%\}}|<%=?({_ID})%>|\[\$({_ID})\]|\$\{{({_ID})\}}|%%({_ID})%%", re.I)
# The words of the usual Latin filler, and keys hit at random.
LOREM = set("lorem ipsum dolor sit amet sed ut enim quis veniam nostrud ullamco labore magna aliqua tempor irure velit culpa mollit anim".split())
KEYS = set("asdf sdfg fdsa qwer jkl blah bla".split())
#: A line that is no more than the status of a server.
STATUS = re.compile(r"(?:error |http )?[45]\d\d\b:?(?: [a-z]+(?: [a-z]+){0,3})?", re.I)
# What a server says in a page or message of its own, in machine format.
MACHINE = re.compile(r"(?:<(?:!doctype|html|\?xml|head|body|div|center|title|p|h\d|fault|noscript)\b|\{\"(?:error|status|code|message)\")", re.I)
SAID = re.compile(r"(?<![\d.])[45]\d\d(?![\d.])|bad (?:request|gateway)|unauthorized|forbidden|not found|timeout|too many requests|server error|unavailable", re.I)
# Without one of these in lower case, FIELD finds nothing.
FIELD_PARTS = ["title", "author", "abstract", "keyword", "affiliation", "doi", "journal", "pub", "mail", "acknowledg", "funding"]
OPENINGS = [a for a, _ in DELIMITERS]

MARKS = str.maketrans({"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\r": "\n", "\u00a0": " ", "\u202f": " ", "\u2009": " ", "\u00ad": None, "\u200b": None, "\u200c": None, "\u200d": None, "\u2060": None, "\ufeff": None})
ODD = re.compile("[ﬀ-ﬄ\r\u00a0\u202f\u2009\u00ad\u200b-\u200d\u2060\ufeff]")
STRIP = re.compile(
    r"[%\\`“«$](?:"
    r"(?<=%)(?<!\\%)[^\n]*"
    r"|(?<=\\)(?:begin\{(comment|verbatim\*?|lstlisting|Verbatim|minted|filecontents\*?|equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math)\}.*?(?:\\end\{\1\}|\Z)"
    r"|iffalse\b.*?(?:\\fi\b|\Z)"
    r"|(?:cite[pt]?|ref|eqref|autoref|label|input|include|subfile|includegraphics|bibliography|bibliographystyle)\*?(?:\[[^\]\n]*\])?\{[^}\n]*\}"
    r"|(?:newcommand|renewcommand|providecommand|def|gdef|let|DeclareMathOperator|usepackage|documentclass|newtheorem|setlength)\b[^\n]*"
    r"|(?:texttt|url|href|lstinline|path)\{[^{}]*\}"
    r"|verb\*?([^\w\s*])[^\n]*?\2"
    r"|\[.*?\\\]|\(.*?\\\))"
    r"|(?<=`)`[^\n]*?''|(?<=“)[^\n]*?”|(?<=«)[^\n]*?»"
    r"|(?<=\$)(?<!\\\$)(?:\$.*?\$\$|[^$\n]*\$)"
    r")",
    re.S,
)
BREAK = re.compile(r"\\(?:title|author|date|(?:sub)*section|paragraph|caption|footnote|item|and|begin\{[^}\n]*\}|end\{[^}\n]*\})\*?(?:\[[^\]\n]*\])?")
SLOTS = re.compile(r"\\(title|author|(?:sub)*section)\*?\{([^\n]*)\}[ \t\r]*(?:\n|$)")
COMMAND = re.compile(r"\\[A-Za-z]+\*?|\\\\")
MARKUP = re.compile(r"\\[A-Za-z]|\$")
#: Stands for what was taken out.
GONE = " ¤ "
WORD = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"\w+|¤")
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REPEAT = re.compile(r"\b(\w+(?: \w+){0,3})(?:[ ,.]+\1\b){3,}", re.I)
# Blanks of an identifier and of a date.
BLANK = re.compile(r"\b10\.x{4,}|\bdd([./-])mm\1y{2,4}\b", re.I)
#: Between two clauses: after closing punctuation (not of an initial), at a dash, at tags.
CLAUSE = re.compile(r"\n+|(?<=[.!?:;>])(?<!\b[A-Z]\.) | --+ |(?=<)|(?<=>)")
BLANKS = re.compile(r"[^\S\n]+")
#: Where a clause without closing punctuation may end: before a capital or something taken out.
CAPITAL = re.compile(r"(?<=[^\s.!?:;]) (?=[^\W\d_a-zß-öø-ÿ]|¤)")
#: Differs from record to record within one template: paths, a word in parentheses, what holds a digit.
VARIES = re.compile(r"\b[^\W\d]*+\d\w*|\([^()\s]*\)")
PATHS = re.compile(r"(?<![^\s<>])[^\s<>/]*+/[^\s<>]*")
#: A unit has a word of three letters to be told from others.
TELLS = re.compile(r"[^\W\d_]{3}")


def kept(text: str) -> str:
    """text without what is not printed; a formula, quotation or the like leaves GONE. Text after the end of the document is cut."""
    if ODD.search(text):
        text = text.translate(MARKS)
    if "%" in text or "[$" in text or "${" in text:
        text = PROTECT.sub(lambda m: "{{" + next(filter(None, m.groups())) + "}}", text)
    text = STRIP.sub(GONE, text)
    end = text.find("\\end{document}")  # one in a comment or a listing is gone by now
    return text[:end] if end >= 0 else text


def printed(text: str) -> str:
    """What is printed, a unit to a line."""
    return COMMAND.sub(" ", BREAK.sub("\n", kept(text)))


def latin(line: str) -> bool:
    """Keys hit at random, or words of the usual Latin filler."""
    run = keys = 0
    for w in PIECE.findall(line.lower()):
        run = run + 1 if w in LOREM else 0
        keys = keys + 1 if w in KEYS or w.startswith("xx") and not w.strip("x") else 0
        if run >= 4 or keys >= 3:
            return True
    return False


def repeated(line: str) -> bool:
    """Filler in place of content, told by itself alone: one phrase again and again, or hardly any different words."""
    low = PIECE.findall(line.lower())
    if len(low) >= 8 and REPEAT.search(line):
        return True
    # numbers and what was taken out count as words of their own
    low = [f"{GONE}{i}" if w == GONE.strip() else w for i, w in enumerate(low)]
    return len(low) >= 16 and len(set(low)) <= len(low) - 11 and any(len(set(low[i : i + 16])) <= 5 for i in range(len(low) - 15))


def thrice(line: str) -> bool:
    """One clause three times in a row."""
    units = [p.strip("{} ").casefold() for p in CLAUSE.split(plain(line)) if p]
    return any(a == b == c and _says(a) for a, b, c in zip(units, units[1:], units[2:]))


def _suspect(line: str) -> bool:
    """Whether latin() or repeated() may find something, in a looser way than they do: a false answer is sure."""
    if len(line) < 8:  # three words of two letters
        return False
    low = line.lower()
    words = PIECE.findall(low)
    some = set(words)
    if "xx" in low or not KEYS.isdisjoint(some) or not LOREM.isdisjoint(some) and sum(w in LOREM for w in words) >= 4:
        return True
    many = len(words) - len(some)  # of 16 words with 5 different ones, 11
    return many >= 11 or many >= 3 and any(a == b == c == d for k in (1, 2, 3, 4) for a, b, c, d in zip(words, words[k:], words[2 * k :], words[3 * k :]))


def plain(text: str) -> str:
    """text without what varies within a template."""
    return VARIES.sub("0", PATHS.sub("0", text) if "/" in text else text)


def key(unit: str) -> int:
    """64 bits that stand for a unit of any length, whatever its case."""
    return _int(blake2b(unit.casefold().encode("utf-8", "surrogatepass"), digest_size=8))


def _int(h: object) -> int:
    return int.from_bytes(h.digest(), "little", signed=True)


def _says(unit: str) -> bool:
    return "¤" not in unit and TELLS.search(unit) is not None


def _unwrap(unit: str) -> str:
    """unit without the braces of a command's argument around it."""
    return unit[1:-1].strip() if unit[:1] == "{" and unit[-1:] == "}" and (unit[:2] != "{{" or unit[:3] == "{{{") else unit


class Units:
    """What one record gives to the inductions, as keys: `slots` (role, value, holds its own name), `units` (whole clauses, with their
    lengths), `heads` (clauses up to a capital within) and `frames` (key, field name, whole unit). `hit`: residue by itself alone."""

    def __init__(self, text: str, fixed: bool = True):
        left = kept(text)
        self.page = MARKUP.search(text) is None
        self.slots: dict[tuple[str, int], bool] = {}
        self.units: dict[int, int] = {}
        self.heads: set[int] = set()
        self.frames: set[tuple[int, str, bool]] = set()
        values = []

        def slot(m: re.Match) -> str:
            values.append((m.group(1).removeprefix("sub").removeprefix("sub"), " ".join(COMMAND.sub(" ", m.group(2)).split())))
            return "\n\n"

        body = BLANKS.sub(" ", COMMAND.sub(" ", BREAK.sub("\n", SLOTS.sub(slot, left))))
        self.hit = self._alone([*filter(None, body.split("\n")), *[v for _, v in values if v]], fixed)
        body = plain(body)
        low = body.lower()
        names = [x for x in FIELD_PARTS if x in low]
        for role, v in values:
            value = plain(v)
            words = WORD.findall(value.lower())
            if len(words) >= 2 and "¤" not in value:
                self.slots[role, key(value)] = role in words and len(words) <= 6
            self._frames(value)
        again = last = 0
        for p in CLAUSE.split(body):
            if p:
                last, before = self._clause(p.strip("{} ")), last
                again += last is not None and last == before
        self.hit = self.hit or again >= 2 and any(map(thrice, body.split("\n")))
        if names:
            for line in body.split("\n"):
                low = line.lower()
                if any(x in low for x in names):
                    line = _unwrap(line.strip())
                    for p in {line, *[p.strip() for p in CLAUSE.split(line) if p]}:
                        self._frames(p)

    def _clause(self, p: str) -> int | None:
        own = key(p) if _says(p) else None
        if own is not None:
            self.units[own] = len(p)
        if "¤" not in p and p[1:] == p[1:].lower():  # no capital within
            return own
        h, at = blake2b(digest_size=8), 0
        for m in CAPITAL.finditer(p):  # every head from the one before it
            h.update(p[at : m.start()].casefold().encode("utf-8", "surrogatepass"))
            at = m.start()
            self.heads.add(_int(h))
            if p[m.end()] == "¤":
                break
        return own

    def _frames(self, unit: str) -> None:
        for find in (FIELD, FIELD_US):
            for m in find.finditer(unit):
                name = re.sub(r"[ _-]", "", m.group(1).lower())
                a, z = TOKEN.findall(unit[: m.start()]), TOKEN.findall(unit[m.end() :])
                if not a and not z:
                    continue
                self.frames.add((key(" ".join([*a, "\0", *z])), name, True))
                for i in {len(a), *range(min(len(a), CONTEXT) + 1)}:  # from the start of the unit, or of a context within
                    h = blake2b(" ".join([*a[len(a) - i :], "\0"]).casefold().encode("utf-8", "surrogatepass"), digest_size=8)
                    if i:
                        self.frames.add((_int(h), name, False))
                    for t in z if i == len(a) else z[:CONTEXT]:
                        h.update(f" {t}".casefold().encode("utf-8", "surrogatepass"))
                        self.frames.add((_int(h), name, False))

    @staticmethod
    def _alone(lines: list[str], fixed: bool) -> bool:
        """What one record shows by itself: repetition in it, and what the fixed values find."""
        for line in lines:
            if _suspect(line) and (repeated(line) or fixed and latin(line)):
                return True
            if fixed and (len(line) < 60 and STATUS.fullmatch(line.strip("{} ")) or line[0] in "<{" and MACHINE.match(line) and SAID.search(line)):
                return True
        if fixed:
            body = "\n".join(lines).lower()
            return any(a in body for a in OPENINGS) and SLOT.search(body) is not None or ("xxx" in body or "yy" in body) and BLANK.search(body) is not None
        return False


_KEYS = pa.list_(pa.int64())
SCHEMA = pa.schema([
    ("id", pa.int64()), ("family", pa.int64()), ("page", pa.bool_()), ("hit", pa.bool_()), ("units", _KEYS), ("sizes", pa.list_(pa.int32())), ("heads", _KEYS),
    ("slots", pa.list_(pa.struct([("role", pa.string()), ("value", pa.int64()), ("own", pa.bool_())]))),
    ("frames", pa.list_(pa.struct([("frame", pa.int64()), ("name", pa.string()), ("whole", pa.bool_())]))),
])
DDL = "id long, family long, page boolean, hit boolean, units array<long>, sizes array<int>, heads array<long>, slots array<struct<role: string, value: long, own: boolean>>, frames array<struct<frame: long, name: string, whole: boolean>>"


def _scan(batches: Iterator[pa.RecordBatch], fixed: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            u = Units(t.as_py(), fixed)
            slots = [{"role": r, "value": v, "own": own} for (r, v), own in u.slots.items() if r != "section" or own]
            rows.append({"id": i, "family": k, "page": u.page, "hit": u.hit, "units": list(u.units), "sizes": list(u.units.values()) if u.page else None, "heads": list(u.heads), "slots": slots, "frames": [dict(zip(("frame", "name", "whole"), f)) for f in u.frames]})
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def found(df: DataFrame, ident: str, text: str, family: str, names: int = NAMES, papers: int = PAPERS, fixed: bool = True) -> DataFrame:
    """`<ident>` of each record with residue, once. Null, empty, blank and truncated texts are none by themselves; a null id is no
    record. Records with the same `family` are versions of one paper and count once; those with a null family support no default and
    no error template, but are searched like all others. `fixed=False` leaves the result to the inductions alone.

    The texts are read and scanned once. What is induced from (keys of 8 bytes, some dozens a record) is written once; supports are
    counted by two-step aggregates, and the templates found, a few hundred, are joined back without a shuffle of the records."""
    c = F.col
    rows = df.select(c(ident).cast("long").alias("id"), F.when(c(family).isNotNull(), F.xxhash64(family)).alias("family"), c(text).cast("string").alias("t"))
    scanned = rows.where("id is not null and t is not null and trim(t) <> ''").mapInArrow(lambda it: _scan(it, fixed), DDL)
    return decide(scanned, names, papers).withColumnRenamed("id", ident)


def frames_of(seen: DataFrame, names: int) -> DataFrame:
    """`frame` of the templates with a slot. A frame's field names are few, so its papers are told by the least and greatest of each."""
    c = F.col
    own = F.coalesce("family", "id")
    each = seen.select(own.alias("own"), F.inline("frames")).groupBy("frame", "name").agg(F.min("own").alias("a"), F.max("own").alias("z"), F.max("whole").alias("whole"))
    all_ = each.groupBy("frame").agg(F.count("*").alias("names"), F.max("whole").alias("whole"), F.array_distinct(F.concat(F.collect_list("a"), F.collect_list("z"))).alias("who"))
    return all_.where((c("names") >= names) & (F.size("who") >= names) & c("whole")).select("frame")


def defaults_of(seen: DataFrame, papers: int) -> DataFrame:
    """`unit`: values of slots that are defaults."""
    c = F.col
    mine = seen.where("family is not null")
    slots = mine.select("family", F.inline("slots"))
    known = slots.groupBy("value").agg(F.max("own").alias("own"), F.max(c("role") == "title").alias("title"), F.max(c("role") == "author").alias("author"), (F.min("family") < F.max("family")).alias("again")).where("again")
    # values of one slot only are told from words of an article by where else they stand
    units = mine.select("family", F.explode(F.concat("units", "heads")).alias("value")).join(broadcast_if_small(known.select("value")), "value")
    where = slots.select("value", "family", "role").unionByName(units.select("value", "family", F.lit("unit").alias("role"))).groupBy("value", "family").agg(F.max(c("role") == "unit").alias("unit"))
    counted = where.groupBy("value").agg(F.count("*").alias("papers"), F.max("unit").alias("unit")).where(c("papers") >= papers)
    both = c("title").cast("int") + c("author").cast("int") + c("unit").cast("int") >= 2
    return counted.join(known, "value").where(c("own") | both).select(c("value").alias("unit"))


def errors_of(seen: DataFrame) -> DataFrame:
    """`unit`: units of whole pages that repeat."""
    c = F.col
    mine = seen.where("family is not null")
    pages = mine.where("page").select("id", "family", F.inline(F.arrays_zip(c("units").alias("unit"), c("sizes").alias("size"))))
    again = pages.groupBy("unit").agg((F.min("family") < F.max("family")).alias("again"))
    marked = pages.join(again, "unit")
    mostly = marked.groupBy("id").agg((F.sum(F.when(c("again"), c("size")).otherwise(0)) * 3 >= F.sum("size")).alias("mostly")).where("mostly").select("id")
    on_pages = marked.where("again").join(mostly, "id", "left_semi").select("unit", "family").distinct().groupBy("unit").agg(F.count("*").alias("on_pages")).where("on_pages >= 2")
    held = mine.select("family", F.explode("units").alias("unit")).join(broadcast_if_small(on_pages), "unit").groupBy("unit", "family").agg(F.first("on_pages").alias("p"))
    counted = held.groupBy("unit").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    return counted.where("n >= 3 and (2 * p >= n or p >= 3 and 4 * p >= n)").select("unit")


def decide(scanned: DataFrame, names: int = NAMES, papers: int = PAPERS) -> DataFrame:
    """`id` of the records that hold one of the templates induced from all of them, and of those that the fixed values found."""
    from rasm.session import checkpoint

    c = F.col
    seen = checkpoint(scanned)  # every record's keys, written once for the three inductions and the search
    residue = checkpoint(defaults_of(seen, papers).unionByName(errors_of(seen)).distinct())
    slots = checkpoint(frames_of(seen, names))
    units = seen.select("id", F.explode(F.concat("units", "heads", F.transform("slots", lambda s: s["value"]))).alias("unit"))
    frames = seen.select("id", F.inline("frames")).select("id", "frame")
    hits = seen.where("hit").select("id").unionByName(units.join(broadcast_if_small(residue), "unit").select("id")).unionByName(frames.join(broadcast_if_small(slots), "frame").select("id"))
    return hits.distinct()
