"""Column functions over host names and labels."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level registry labels, frequent English letter pairs, readable words.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go"]
COMMON_BIGRAMS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le "
                  "ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur").split()
CONSONANT_RUNS, DIGIT_RUNS = "[bcdfghjklmnpqrstvwxyz]+", "[0-9]+"
NAME_PATTERN = "^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(name) -> Column:
    """Lower case, trailing dots removed; null becomes ''."""
    return F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[.]+$", "")


def first_label(name) -> Column:
    return F.get(F.split(clean_name(name), "[.]"), F.lit(0))


def registrable_name(name) -> Column:
    parts = F.split(clean_name(name), "[.]")
    n = F.size(parts)
    tld, second = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    keep = F.when((F.length(tld) == 2) & second.isin(SECOND_LEVEL), 3).otherwise(2)
    return F.when(n <= 2, F.array_join(parts, ".")).otherwise(F.array_join(F.slice(parts, n - keep + 1, keep), "."))


def domain_label(name) -> Column:
    """First label of a well-formed name, '' otherwise."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(col(name), F.lit("")))), "[.]+$", "")
    ok = (F.length(text) <= 253) & text.rlike(NAME_PATTERN)
    return F.when(ok, F.get(F.split(text, "[.]"), F.lit(0))).otherwise(F.lit(""))


def canonical_log_name(name) -> Column:
    """Lower-cased ASCII name with valid label and wire lengths ('.' for the root), null otherwise."""
    text = F.lower(F.regexp_replace(col(name), "[.]$", ""))
    ok = (F.length(text) <= 253) & text.rlike("^[\\x00-\\x7F]+$") & text.rlike("^[^.]{1,63}([.][^.]{1,63})*$")
    return F.when(col(name).isin("", "."), F.lit(".")).when(ok, text)


def char_counts(text) -> Column:
    """Occurrences of each distinct character."""
    c = col(text)
    return F.transform(F.array_distinct(F.split(c, "")), lambda x: F.length(c) - F.length(F.replace(c, x, F.lit(""))))


def char_entropy(text) -> Column:
    """Shannon entropy in bits of a string's characters; 0 for the empty string."""
    c = col(text)
    n = F.length(c).cast("double")
    total = F.aggregate(char_counts(c), F.lit(0.0), lambda a, k: a + k * F.log2(k.cast("double")))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.log2(n) - total / n)).otherwise(F.lit(0.0))


def ngrams(text, n: int) -> Column:
    c = col(text)
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def bigram_surprise(label) -> Column:
    pairs = ngrams(label, 2)
    odd = F.size(F.filter(pairs, lambda p: ~p.isin(COMMON_BIGRAMS)))
    return odd / F.greatest(F.lit(1), F.size(pairs))


def ratio_of(label, pattern) -> Column:
    return F.regexp_count(col(label), F.lit(pattern)) / F.greatest(F.lit(1), F.length(col(label)))


def longest_run(label, pattern) -> Column:
    c = col(label)
    runs = F.transform(F.regexp_extract_all(c, F.lit("(" + pattern + ")"), 1), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0)) / F.greatest(F.lit(1), F.length(c))


def lexical_features(label) -> dict:
    """Ten composition numbers of one label."""
    c = col(label)
    n = F.greatest(F.lit(1), F.length(c))
    pairs = ngrams(c, 2)
    digit = "^[0-9]$"

    def edge(p):
        return F.substr(p, F.lit(1), F.lit(1)).rlike(digit) != F.substr(p, F.lit(2), F.lit(1)).rlike(digit)

    distinct = F.when(F.length(c) > 0, F.size(F.array_distinct(F.split(c, "")))).otherwise(0)
    return {
        "log_length": F.log1p(F.length(c)),
        "entropy": char_entropy(c),
        "digit_ratio": ratio_of(c, "[0-9]"),
        "vowel_ratio": ratio_of(c, "[aeiou]"),
        "hyphen_ratio": ratio_of(c, "-"),
        "unique_ratio": distinct / n,
        "consonant_run": longest_run(c, CONSONANT_RUNS),
        "digit_run": longest_run(c, DIGIT_RUNS),
        "digit_transitions": F.size(F.filter(pairs, edge)) / n,
        "repeat_ratio": F.size(F.filter(pairs, lambda p: F.substr(p, F.lit(1), F.lit(1)) == F.substr(p, F.lit(2), F.lit(1)))) / n,
    }


def guard_features(label) -> dict:
    """The inputs of the lexical rules for one label; an empty label is not examined."""
    c = col(label)
    some = lambda x: F.when(F.length(c) > 0, x).otherwise(F.lit(0.0))
    return {"domain_entropy": some(char_entropy(c)), "domain_label_length": F.length(c),
            "domain_digit_ratio": some(ratio_of(c, "[0-9]")), "bigram_surprise": some(bigram_surprise(c)),
            "domain_vowel_ratio": some(ratio_of(c, "[aeiou]")), "domain_consonant_run": some(longest_run(c, CONSONANT_RUNS))}


def conservative_rule(f: dict) -> Column:
    return (f["domain_entropy"] >= 3.5) & (f["bigram_surprise"] >= 0.8) & (f["domain_label_length"] >= 20)


def validation_rule(f: dict) -> Column:
    n, h, s, v, run = (f[k] for k in ("domain_label_length", "domain_entropy", "bigram_surprise", "domain_vowel_ratio", "domain_consonant_run"))
    brief = n.between(8, 15) & (h >= 2.5) & (s >= 0.9) & (v <= 0.2) & (run >= 0.35)
    lengthy = (n >= 16) & (h >= 3.4) & (s >= 0.8) & (v <= 0.3)
    return brief | lengthy


def label_shape(label) -> Column:
    c = col(label)
    return (F.when(c.rlike("^[0-9]+$"), "digits_only").when(c.contains("-"), "hyphenated")
            .when((F.length(c) >= 8) & c.rlike("[0-9]") & c.rlike("^[0-9a-f]*$"), "hexadecimal_shaped")
            .when(c.rlike("[0-9]"), "mixed_alphanumeric")
            .when(F.length(c) < 12, "letters_only_short").otherwise("letters_only_long"))


def guard_failures(length, entropy, surprise) -> Column:
    """Names of the unmet guard conditions joined by '+', or 'passes'."""
    missed = F.array_compact(F.array(F.when(col(length) < 20, "length"), F.when(col(entropy) < 3.5, "entropy"),
                                     F.when(col(surprise) < 0.8, "bigram_surprise")))
    return F.when(F.size(missed) == 0, F.lit("passes")).otherwise(F.array_join(missed, "+"))


def is_readable(label, words) -> Column:
    """Every hyphen-separated part splits fully into `words`, with two or more words overall.

    For each part the reachable split positions are extended left to right: position
    j is reachable if some reachable i has part[i:j] in the list."""
    c = F.lower(col(label))
    usable = [w for w in words if len(w) >= 2]
    longest = max(map(len, usable))
    parts = F.filter(F.split(c, "-"), lambda p: F.length(p) > 0)

    def splits(p):
        def grow(reached, j):
            ok = F.exists(reached, lambda i: (j - i <= longest) & F.substr(p, i + 1, j - i).isin(usable))
            return F.when(ok, F.array_append(reached, j)).otherwise(reached)

        return F.array_contains(F.aggregate(F.sequence(F.lit(1), F.length(p)), F.array(F.lit(0)), grow), F.length(p))

    alpha = F.forall(parts, lambda p: p.rlike("^\\p{L}+$"))
    whole = F.forall(parts, splits)
    return (F.size(parts) > 0) & alpha & whole & ((F.size(parts) >= 2) | ~c.isin(list(words)))


def tunnel_name(name) -> dict:
    """Base (last two labels) and the shape of the labels in front of it."""
    labels = F.split(clean_name(name), "[.]")
    n = F.size(labels)
    front = F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(front, "")
    return {"dns_base": F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."), "dns_label_count": n,
            "dns_encoded_max_label_length": F.coalesce(F.array_max(F.transform(front, F.length)), F.lit(0)),
            "dns_encoded_total_length": F.length(joined), "dns_encoded_entropy": char_entropy(joined)}
