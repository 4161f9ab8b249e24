"""Column builders for names, words, chunks, caps and message predicates. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as content of a message.
STOPWORDS = (
    "the and for are but not you all any can her was one our out has have had been from this that they them then than "
    "what when where which who how why will with would could should does done make made just also into over such take "
    "only come some very work each like more about after being before between both here there these those under first "
    "still every need want tell show give keep lets look"
).split()

# Further words that never become concepts.
STOP_CONCEPTS = STOPWORDS + (
    "using used uses based added via etc new name type path file tool data code test runs main true false none null default"
).split()

# Messages that need no recall, by kind.
SKIP_PATTERNS = {
    "edit": r"^\s*(fix|edit|change|update|add|remove|delete|move|rename)\s",
    "vcs": r"^\s*(commit|push|pull|merge|rebase|checkout|stash)\s",
    "run": r"^\s*(run|test|build|deploy|install|npm|uv|pip|git)\s",
    "reply": r"^\s*(yes|no|ok|sure|thanks|yeah|nah|nope|yep|cool|done|lgtm)\s*[.!]?\s*$",
    "slash": r"^\s*/",
    "number": r"^\s*\d+\s*$",
}
DIRECTIVE = r"^\s*(look|check|see|tell|give|show|write|read|find|list|open|close|save|use|try|set|get|put|let|make|take|keep|pick|drop|go|do|can|will|just|now|here|also|then|please|should|could|would|might)\s"
ENTITY_SHAPE = r"[a-zA-Z][a-zA-Z0-9]*-[a-zA-Z0-9-]{4,}"
QUESTION = r"^\s*(what|who|where|when|why|how|which|does|is|are|can|did|do|has|have|will|should|could|would)\s"
SIGNAL = r"(?i)\b(shipped|deployed|committed|decided|fixed|broke|learned|built|resolved|debugged|implemented|merged|released)\b"
PATH_EXTENSIONS = "py md json yml yaml ts tsx js jsx rs go sh sql html css toml pcf gs".split()


def _kebab(name: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(F.replace(spaced, F.lit("_"), F.lit("-")))


def _dashes(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "-+", "-"), F.lit("-"))


def normalize_name(name: Column) -> Column:
    """B1: camel, Pascal and snake case to kebab case; idempotent."""
    return _dashes(_kebab(name))


def slug_title(title: Column) -> Column:
    """B2: as normalize_name, other characters become dashes, at most 60 characters."""
    return F.substring(_dashes(F.regexp_replace(_kebab(title), "[^a-z0-9-]", "-")), 1, 60)


def research_slug(topic: Column, date: Column) -> Column:
    """`research-<date>-<slug>`; the slug is cut to 50 before its dashes are trimmed."""
    cut = F.substring(F.regexp_replace(F.lower(F.trim(topic)), "[^a-z0-9-]", "-"), 1, 50)
    return F.concat(F.lit("research-"), date, F.lit("-"), F.regexp_replace(F.btrim(cut, F.lit("-")), "-+", "-"))


def query_tokens(message: Column) -> Column:
    """B4, in order and with repeats: words of three or more that begin with a letter."""
    clean = F.regexp_replace(F.lower(message), r"[^a-z0-9\s-]", " ")
    return F.regexp_extract_all(clean, F.lit("[a-z][a-z0-9_.-]{2,}"), 0)


def content_words(message: Column) -> Column:
    """Distinct query tokens without stopwords."""
    return F.array_except(F.array_distinct(query_tokens(message)), F.array(*map(F.lit, STOPWORDS)))


def hyphen_ngrams(words: Column) -> Column:
    """All runs of one to three words, joined by dashes. The words are bound, so they are made once and not for each run."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), n - i + 1)), lambda k: F.array_join(F.slice(w, i, k), "-")))

    none = F.array().cast("array<string>")
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.flatten(runs(w))).otherwise(none)), 0)


def stem_variants(word: Column) -> Column:
    """The word and its plain stems."""
    n = F.length(word)
    cut = lambda k, tail="": F.concat(F.substring(word, F.lit(1), n - k), F.lit(tail))
    plural = F.when(word.endswith("ies"), cut(3, "y")).when(word.endswith("es"), cut(2)).when(word.endswith("s") & ~word.endswith("ss"), cut(1))
    return F.array_compact(F.array(word, plural, F.when(word.endswith("ing") & (n > 5), cut(3)), F.when(word.endswith("ed") & (n > 4), cut(2))))


def name_parts(name: Column) -> Column:
    """Distinct letter runs of three or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z]{3,}"), 0))


def concept_words(text: Column) -> Column:
    """Distinct words that may become concepts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z0-9]{2,}"), 0)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_CONCEPTS)))


def token_estimate(text: Column) -> Column:
    """Characters div 4."""
    return F.floor(F.length(text) / 4)


def cost_estimate(tokens: Column, first: float = 0.80, second: float = 3.00) -> Column:
    """A first pass over all tokens and a second over a tenth, in USD per million."""
    return tokens / 1e6 * first + tokens * 0.1 / 1e6 * second


def chunk_text(text: Column, tokens: int) -> Column:
    """Windows of 4 * tokens characters; a short or empty text is one chunk."""
    size = 4 * tokens
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def cap_with_marker(text: Column, limit: int) -> Column:
    """Cut and say how much went."""
    n = F.length(text)
    return F.when(n > limit, F.concat(F.substring(text, 1, limit), F.lit("...[+"), (n - limit).cast("string"), F.lit("]"))).otherwise(text)


def translate_path(path: Column, prefixes: dict[str, str]) -> Column:
    """Rewrite the first prefix that fits."""
    out = path
    for old, new in reversed(list(prefixes.items())):
        out = F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(out)
    return out


def detect_context(cwd: Column) -> Column:
    """Where a session ran."""
    return F.when(cwd.startswith("/workspaces/"), F.lit("devcontainer")).otherwise(F.lit("host"))


def truncate_bytes(text: Column, budget: int, mark: str = "\n[truncated]") -> Column:
    """Cut to a UTF-8 byte budget at a whole character, and mark the cut.

    The bytes are cut; where that breaks a character, its first bytes, three at most, go as well.
    """
    cut = F.substring(F.encode(text, "UTF-8"), 1, budget)
    last = lambda k: F.hex(F.substring(cut, -k, 1))
    begins = lambda k, first: last(k) >= first  # noqa: E731  C0: two bytes or more, E0: three or more, F0: four
    broken = F.when(last(1) < "80", 0).when(begins(1, "C0"), 1).when(begins(2, "E0"), 2).when(begins(2, "C0"), 0).when(begins(3, "F0"), 3).otherwise(0)
    whole = F.decode(F.substring(cut, F.lit(1), F.lit(budget) - broken), "UTF-8")
    return F.when(F.octet_length(text) > budget, F.concat(whole, F.lit(mark))).otherwise(text)


def skip_reason(message: Column) -> Column:
    """Why a message needs no recall; null when it does."""
    m = F.trim(message)
    out = F.when(F.length(m) < 15, F.lit("short"))
    for reason, pattern in SKIP_PATTERNS.items():
        out = out.when(m.rlike(f"(?i){pattern}"), F.lit(reason))
    return out.when((F.length(m) < 50) & m.rlike(f"(?i){DIRECTIVE}") & ~m.rlike(ENTITY_SHAPE), F.lit("directive"))


def is_question(message: Column) -> Column:
    """C2."""
    return message.contains("?") | message.rlike(f"(?i){QUESTION}")


def path_like(token: Column) -> Column:
    """Looks like a file path."""
    t = F.trim(token)
    base = F.regexp_replace(t, r":\d+$", "")
    known = base.rlike(r"\.(" + "|".join(PATH_EXTENSIONS) + ")$")
    last = F.element_at(F.split(base, "/"), -1)
    ok = (t != "") & ~t.contains(" ") & ~t.startswith("-") & ~t.startswith("http") & ~t.contains("(") & ~t.endswith(")")
    return ok & (known | (base.contains("/") & last.contains(".") & ~last.startswith(".")))
