"""Header texts as facts: function-like macros, aliases, inline functions, container templates, and the version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings of the functions that a container template makes.
STACK = "num value new new_null new_reserve reserve free zero delete delete_ptr push unshift pop shift pop_free insert set find find_ex find_all sort is_sorted dup deep_copy set_cmp_func".split()
HASH = "new free flush insert delete retrieve error num_items node_stats_bio node_usage_stats_bio stats_bio get_down_load set_down_load doall".split()
# Beginnings of names that count, and macros that declare containers and do not count.
BEGINNINGS = "SSL_ TLS_ DTLS_ EVP_ BIO_ X509_ ASN1_ OPENSSL_ CRYPTO_ RSA_ EC_ ECDSA_ ECDH_ DH_ DSA_ BN_ ERR_ PEM_ PKCS DES_ AES_ HMAC_ MD5_ SHA RAND_ OSSL_ OBJ_ NCONF_ GENERAL_ OCSP_ CMS_ CT_ TS_ SMIME_ COMP_ ENGINE_ UI_ CONF_ ASYNC_".split()
DECLARING = """STACK_OF LHASH_OF SKM_DEFINE_STACK_OF SKM_DEFINE_STACK_OF_INTERNAL DEFINE_STACK_OF DEFINE_STACK_OF_CONST
DEFINE_SPECIAL_STACK_OF DEFINE_SPECIAL_STACK_OF_CONST DEFINE_LHASH_OF DEFINE_LHASH_OF_INTERNAL IMPLEMENT_LHASH_DOALL_ARG
IMPLEMENT_LHASH_DOALL_ARG_CONST int_implement_lhash_doall DECLARE_LHASH_HASH_FN IMPLEMENT_LHASH_HASH_FN DECLARE_LHASH_COMP_FN
IMPLEMENT_LHASH_COMP_FN DECLARE_LHASH_DOALL_ARG_FN IMPLEMENT_LHASH_DOALL_ARG_FN LHASH_HASH_FN LHASH_COMP_FN
LHASH_DOALL_ARG_FN LH_LOAD_MULT""".split()
#: What a directive or a declaration can be.
WORD, WORD_ONLY = "^[A-Za-z_][A-Za-z0-9_]*", r"^\s+[A-Za-z_][A-Za-z0-9_]*\s*$"


def directives(text: Column) -> Column:
    """What stands after `#define`, for each line that has one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s*#\s*", "#"))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^#define\s")), lambda x: F.regexp_replace(x, r"^#define\s+", ""))


def after(text: Column, word: str) -> Column:
    """The pieces of a text that follow each place of a word."""
    pieces = F.split(text, word)
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _argument(piece: Column) -> Column:
    """The first argument of a call whose bracket opens the piece, without its quotes; empty if there is none."""
    inner = F.substring_index(F.substring_index(F.regexp_replace(piece, r"^\s*\(\s*", "("), ")", 1), ",", 1)
    return F.when(inner.startswith("("), F.trim(F.substring(inner, 2, 1 << 20))).otherwise("")


def _kinds(text: Column) -> list[Column]:
    """Arrays of (kind, name): what each directive, inline function and container declaration of a text names."""
    named = lambda kind, names: F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    lines = F.transform(directives(text), lambda x: F.struct(F.regexp_extract(x, WORD, 0).alias("name"), F.regexp_replace(x, WORD, "").alias("rest")))
    of = lambda fits: F.transform(F.filter(lines, fits), lambda x: x["name"])
    # a declaration ends at its bracket; the last word before it is the function's
    pieces = F.split(F.regexp_replace(text, r"\s+", " "), "ossl_inline ")
    heads = F.transform(F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: F.struct(F.get(pieces, i - 2).alias("before"), F.get(pieces, i - 1).alias("head")))
    inline = F.filter(heads, lambda h: h["head"].isNotNull() & F.rtrim(h["before"]).rlike("static( ossl_unused)?$") & h["head"].contains("("))
    functions = F.transform(inline, lambda h: F.regexp_extract(F.rtrim(F.substring_index(h["head"], "(", 1)), r"[\s*]([A-Za-z_]\w*)$", 1))
    quoted = lambda word: F.transform(F.filter(F.transform(after(text, word), _argument), lambda a: a.rlike('^"[^"]+"$')), lambda a: F.replace(a, F.lit('"'), F.lit("")))
    plain = lambda word: F.transform(after(text, word), lambda p: F.regexp_extract(_argument(p), WORD, 0))
    return [
        named("explicit_define", of(lambda x: F.ltrim(x["rest"]).startswith("("))),
        named("alias_define", of(lambda x: x["rest"].rlike(WORD_ONLY))),
        named("inline_function", functions),
        named("sk_template", quoted("generate_(?:const_)?stack_macros")),
        named("sk_template", plain("DEFINE_(?:SPECIAL_)?STACK_OF(?:_CONST)?")),
        named("lh_template", quoted("generate_lhash_macros")),
        named("lh_template", plain("DEFINE_LHASH_OF(?:_INTERNAL)?")),
    ]


def macros(headers: DataFrame, text: str = "text") -> DataFrame:
    """Distinct name and kind of what header texts define; a container type stands for all functions of its template.

    One pass over the texts: all kinds are found in one projection, and names are made distinct after it.
    """
    each = headers.where(F.col(text).isNotNull()).select(F.explode(F.concat(*_kinds(F.col(text)))).alias("f")).select("f.*").distinct()
    name, kind = F.col("name"), F.col("kind")
    known = name.rlike("^(?:" + "|".join(BEGINNINGS) + ")")
    plain = ~name.isin(DECLARING) & ~name.startswith("_")
    keep = (
        F.when(kind == "explicit_define", plain)
        .when(kind == "alias_define", plain & known)
        .when(kind == "inline_function", known & ~name.startswith("ossl_check_"))
        .when(kind == "sk_template", ~name.isin("t", "t1", "t2", "t3"))
        .otherwise(name != "type")
    )
    made = lambda head, ends: F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(F.lit(head), name, F.lit("_"), e))
    names = F.when(kind == "sk_template", made("sk_", STACK)).when(kind == "lh_template", made("lh_", HASH)).otherwise(F.array(name))
    return each.where(keep).select("kind", F.explode(names).alias("name")).distinct()


def version(headers: DataFrame, folder: str = "", file: str = "file", text: str = "text") -> DataFrame:
    """One row: the version in opensslv.h, else in opensslv.h.in, else in a part of the folder's path, else `unknown`."""
    v = F.coalesce(_found(text, r'OPENSSL_VERSION_STR\s+"(\d+\.\d+[^"]*)"'), _found(text, r'OPENSSL_VERSION_TEXT\s+"OpenSSL\s+(\d+\.\d+[^\s"]*)'))
    name = F.element_at(F.split(F.col(file), "/"), -1)
    of_text = headers.where(name.isin("opensslv.h", "opensslv.h.in")).select(name.alias("n"), v.alias("v")).agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("n"))).alias("v"))
    parts = F.filter(F.transform(F.reverse(F.split(F.lit(folder), "/")), lambda p: _found(p, r"^[Oo]pen[Ss][Ss][Ll]-?(\d+\.\d+\.\d+\S*)")), lambda p: p.isNotNull())
    return of_text.select(F.coalesce("v", F.get(parts, 0), F.lit("unknown")).alias("version"))


def _found(text: str | Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
