"""Column expressions over text. All stay inside whole-stage code: no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a term, an identifier, a quoted span, a compound name, a call and a hunk look like.
TERM = r"([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"
IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_]*)"
BACKTICKED = r"`([^`\n]+)`"
COMPOUND = r"\b([A-Za-z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*|_[A-Za-z0-9]+)+)\b"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
# The message of a call that nothing resolves, and a fenced diff.
UNRESOLVED = r"(?s)^unresolved call `(.*)`\z"
FENCED_DIFF = r"(?s)```(?:diff|patch)?\n(.*?)```"
#: Counts words and marks; stands in where no vocabulary file is given.
TOKEN = r"([A-Za-z0-9]+|[^A-Za-z0-9 \n\t\r])"


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def terms(text: Column) -> Column:
    """camelCase-aware lower-case terms of two characters or more; other than ASCII letters and digits separate."""
    return F.filter(F.transform(every(F.coalesce(text, F.lit("")), TERM), F.lower), lambda t: F.length(t) > 1)


def identifiers(text: Column) -> Column:
    return every(text, IDENTIFIER)


def mentioned(text: Column) -> Column:
    """Identifiers in backticks, and words with an inner capital or underscore; distinct, in no set order."""
    quoted = F.flatten(F.transform(every(text, BACKTICKED), identifiers))
    return F.array_distinct(F.concat(quoted, every(text, COMPOUND)))


def called(text: Column) -> Column:
    """Names that a call's bracket follows."""
    return every(text, CALL)


def document_terms(name: Column, fq_name: Column, doc: Column) -> Column:
    """A declaration's searchable terms; its name counts twice."""
    return F.concat(terms(name), terms(name), terms(fq_name), terms(doc))


def dense_document(signature: Column, doc: Column) -> Column:
    return F.concat_ws("\n", signature, doc)


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x)), " "), " +", " ")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("int")


def lines(text: Column) -> Column:
    """Lines as a line reader gives them: a final line break begins no line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def unresolved_callee(message: Column) -> Column:
    """The name, without receivers and arguments, that an "unresolved call" message quotes, else null."""
    called_ = F.substring_index(F.regexp_extract(message, UNRESOLVED, 1), "(", 1)
    name = F.trim(F.substring_index(called_, ".", -1))
    return F.when(name != "", name)


def diff_in(reply: Column) -> Column:
    """The unified diff that a reply holds, fenced, after prose or bare; without one the empty string."""
    fenced = F.regexp_extract(reply, FENCED_DIFF, 1)
    body = F.when(F.regexp_like(reply, F.lit(FENCED_DIFF)), fenced).otherwise(reply)
    at = F.instr(body, "diff --git ")
    return F.when(at > 0, F.concat(F.regexp_replace(F.substr(body, at), r"\s+\z", ""), F.lit("\n"))).otherwise("")


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole))


def path_within(path: Column, root: Column) -> Column:
    """By path segments, not by string prefix."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_test_path(path: Column) -> Column:
    return F.contains(path, F.lit("/test")) | F.contains(path, F.lit("/androidTest"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def symbol_id(kind: Column, fq_name: Column, receiver: Column, parameters: Column) -> Column:
    """Signature-derived identity: overloads differ; types that don't resolve are '?'."""
    types = F.transform(parameters, lambda p: F.coalesce(p, F.lit("?")))
    typed = F.when(receiver.isNotNull(), F.concat(F.array(F.concat(F.lit("this:"), receiver)), types)).otherwise(types)
    call = F.concat(F.lit("("), F.array_join(typed, ","), F.lit(")"))
    return (
        F.when(kind == "FUNCTION", F.concat(fq_name, call))
        .when(kind == "CONSTRUCTOR", F.concat(fq_name, F.lit(".<init>"), call))
        .otherwise(fq_name)
    )


def fq_name(kind: Column, container: Column, name: Column, symbol_id_: Column) -> Column:
    """The container's name and the declaration's, "<init>" for a constructor; the id where there is no container."""
    own = F.when(kind == "CONSTRUCTOR", F.lit("<init>")).otherwise(name)
    return F.when(container.isNull(), symbol_id_).otherwise(F.concat_ws(".", F.when(container != "", container), own))


def kind_of(declaration: Column, class_kind: Column) -> Column:
    """The kind of a symbol: companions and anonymous objects are objects, enums, annotations and the like are classes."""
    of_class = F.when(class_kind == "INTERFACE", "INTERFACE").when(class_kind.isin("OBJECT", "COMPANION_OBJECT", "ANONYMOUS_OBJECT"), "OBJECT").otherwise("CLASS")
    return F.when(declaration == "CLASS", of_class).when(declaration.isin("CONSTRUCTOR", "PROPERTY"), declaration).otherwise("FUNCTION")


def signature(declaration: Column, body_offset: Column | None = None) -> Column:
    """What stands between the doc comment and the body, without a closing '='.

    The body begins at body_offset where the parser gives one, else at the first '{' or '=' outside brackets and literals.
    """
    doc = F.regexp_extract(declaration, r"(?s)^(\s*/\*\*.*?\*/)", 1)
    after_doc = F.length(doc)
    if body_offset is None:
        bare = F.substr(declaration, after_doc + 1)
        pieces = every(bare, r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[=!<>]=+|=>|->|[\s\S])")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("end"))

        def step(s: Column, x: Column) -> Column:
            end = s["end"] | ((s["depth"] == 0) & x.isin("{", "="))
            depth = s["depth"] + F.when(x.isin("(", "[", "{"), 1).when(x.isin(")", "]", "}"), -1).otherwise(0)
            return F.struct(depth.alias("depth"), F.when(end, s["at"]).otherwise(s["at"] + F.length(x)).alias("at"), end.alias("end"))

        body_offset = after_doc + F.aggregate(pieces, start, step)["at"]
    head = _stripped(F.substr(declaration, after_doc + 1, body_offset - after_doc))
    within = _stripped(F.substr(declaration, F.lit(1), body_offset))
    return F.when(body_offset <= after_doc, within).otherwise(_stripped(F.regexp_replace(head, r"=\z", "")))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def doc_line(doc: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.try_element_at(F.filter(F.transform(F.split(doc, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))


def callee_text(callee: Column) -> Column:
    return F.substring(F.regexp_replace(callee, r"\s+", " "), 1, 40)


def relative_path(path: Column, root: Column) -> Column:
    """Relative to the root with forward slashes; absolute where it lies outside."""
    slashed, base = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(root, F.lit("/"))
    return F.when(F.startswith(slashed, F.concat(base, F.lit("/"))), F.substr(slashed, F.length(base) + 2)).otherwise(slashed)
