"""Categories from titles: the first list, in order, of which a word occurs anywhere in the lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (category, words), per site and in order, and the default.
FORUM_A = ([("shared", ["shared", "cpanel", "wordpress"]), ("reseller", ["reseller"]), ("cloud", ["cloud"]), ("vps", ["vps", "kvm", "openvz", "virtual"]), ("dedicated", ["dedicated", "dedi", "bare metal"]), ("colo", ["colo"])], "other")
BLOG = (FORUM_A[0], "vps")
FORUM_B = ([("vps", ["vps"]), ("dedicated", ["dedicated"]), ("shared", ["shared", "web hosting"]), ("reseller", ["reseller"]), ("cloud", ["cloud"])], "vps")
FORUM_C = ([("vps", ["vps", "virtual"]), ("dedicated", ["dedicated", "dedi"]), ("shared", ["shared", "reseller"]), ("cloud", ["cloud"])], "other")
LISTINGS = ([("dedicated", ["dedicated"]), ("vps", ["vps", "virtual"]), ("cloud", ["cloud"]), ("shared", ["shared", "hosting"])], "vps")


def categorize(c: Column, rules: tuple) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, words in rules[0]:
        found = low.rlike("|".join(words))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(rules[1])


def alias(c: Column) -> Column:
    return F.when(c == "webhosting", "shared").otherwise(c)
