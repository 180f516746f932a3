"""Normalized payload values: what a value is, its canonical form, and whether that form is faithful.

The owner of a field is the first that claims it, in this order: directory operations,
account flags, generalized times, file times, identities, multi-valued texts, audit
resources. A value without an owner, or a blank one, stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.functions import decode, text, times

#: Fields, lower-cased, that the owners claim by name.
OPERATION_FIELDS = ("operationtype", "actiondetail")
FLAG_FIELDS = ("useraccountcontrol", "olduacvalue", "newuacvalue")
GENERALIZED_FIELDS = ("whenchanged", "whencreated")
FILETIME_FIELDS = ("accountexpires", "badpasswordtime", "lastlogon", "lastlogontimestamp", "lockouttime", "passwordlastset", "pwdlastset")
MULTI_FIELDS = ("serviceprincipalname", "serviceprincipalnames", "spn", "spns", "allowedtodelegateto", "memberof", "members", "privileges")
#: The last file time of the year 9999.
_LAST_FILETIME = 2650467743999999999


def _is(value: Column, kind: str, outcome: str | Column = "Normalized", display: Column | None = None, lossless: bool | Column = True, warning: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = value if display is None else display
    return F.struct(
        value.alias("value"), shown.alias("display"), F.lit(kind).alias("kind"), as_column(outcome).alias("outcome"), as_column(lossless).alias("lossless"),
        (F.lit(None).cast("string") if warning is None else warning).alias("warning"),
    )


def _bad(raw: Column, kind: str, what: str, outcome: str = "Malformed") -> Column:
    return _is(raw, kind, outcome, warning=F.concat(F.lit(f"{what}: "), raw))


def _changed(value: Column, given: Column) -> Column:
    return F.when(value == given, "Unchanged").otherwise("Normalized")


def normalized(field: Column, value: Column, attribute: Column | None = None, type_: Column | None = None) -> Column:
    """A struct (value, display, kind, outcome, lossless, warning) for a field's text.

    ``attribute`` names what a field called AttributeValue holds, ``type_`` is the event's type.
    """
    name, raw = F.lower(field), F.trim(value)
    of = name if attribute is None else F.when(name == "attributevalue", F.lower(F.trim(attribute))).otherwise(name)
    day = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    operation = decode.operation(raw)
    audits = F.lit(False) if type_ is None else F.coalesce(F.upper(type_) == "GROUPPOLICYDIRECTORYAUDIT", F.lit(False))
    operations = F.when(operation.isNotNull(), _is(operation, "DirectoryOperation", _changed(operation, value))).otherwise(_bad(raw, "DirectoryOperation", "unknown directory operation", "UnknownValue"))

    mask = decode.integer(raw)
    names = F.array_sort(decode.flags(mask))
    spelled = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.upper(raw), ","), F.trim), lambda x: x != "")))
    known = reduce(lambda a, b: a | b, [F.upper(raw).contains(n) for _, n in decode.ACCOUNT_FLAGS])
    shown = lambda a: F.when(F.size(a) == 0, "NONE").otherwise(F.array_join(a, ", "))
    strange = F.exists(names, lambda x: x.startswith("UNKNOWN_0x"))
    flags = (
        F.when(mask.isNotNull(), _is(shown(names), "FlagSet", lossless=~strange, warning=F.when(strange, F.lit("unknown bits are kept"))))
        .when(F.upper(raw) == "NONE", _is(F.lit("NONE"), "FlagSet")).when(raw.contains(",") | known, _is(shown(spelled), "FlagSet"))
        .otherwise(_bad(raw, "FlagSet", "neither a mask nor flag names"))
    )

    instant = times.from_generalized(raw)
    digits = F.length(F.rtrim(F.regexp_extract(raw, r"[.,](\d+)", 1), F.lit("0")))
    generalized = F.when(instant.isNotNull(), _is(day(instant), "DateTime", lossless=digits <= 6)).otherwise(_bad(raw, "DateTime", "no generalized time"))

    ticks = raw.try_cast("long")
    filetime = (
        F.when((ticks == 0) & of.isin("pwdlastset", "passwordlastset"), _is(F.lit("PasswordChangeRequired"), "DirectorySentinel", display=F.lit("Must change password at next logon")))
        .when((ticks == 0) | (ticks == times.FILETIME_NEVER), _is(F.lit(None).cast("string"), "DateTime", display=F.lit("Never")))
        .when(ticks.between(1, _LAST_FILETIME), _is(day(times.from_filetime(ticks)), "DateTime", lossless=ticks % 10 == 0)).otherwise(_bad(raw, "DateTime", "no file time"))
    )

    is_sid = (name == "sid") | field.rlike(r"(Sid|SID)$|(?i).[_.\-]sid$")
    guid, dn = decode.guid(raw), decode.distinguished_name(value)
    is_guid = name.endswith("guid") | name.endswith("id") & guid.isNotNull()
    is_oid, is_dn = name.endswith("oid") | name.endswith("objectidentifier"), name.endswith("distinguishedname") | name.endswith("objectdn")
    sid = F.when(raw.rlike(r"^(?i)S-\d(-\d+)+$"), _is(F.upper(raw), "SecurityIdentifier")).otherwise(_bad(raw, "SecurityIdentifier", "malformed SID"))
    guids = F.when(guid.isNotNull(), _is(guid, "Guid")).otherwise(_bad(raw, "Guid", "malformed GUID"))
    oid = F.when(raw.rlike(r"^\d+(\.\d+)+$"), _is(raw, "ObjectIdentifier", _changed(raw, value))).otherwise(_bad(raw, "ObjectIdentifier", "malformed OID"))

    resource = F.when(operation.isNotNull(), _is(operation, "ResourceIdentifier")).otherwise(_bad(raw, "ResourceIdentifier", "unknown resource", "UnknownValue"))
    return (
        F.when(value.isNull() | (raw == ""), _is(value, "Text", "Unchanged"))
        .when(name.isin(*OPERATION_FIELDS) & (audits | operation.isNotNull()), operations).when(name.isin(*FLAG_FIELDS), flags)
        .when(of.isin(*GENERALIZED_FIELDS), generalized).when(of.isin(*FILETIME_FIELDS), filetime)
        .when(is_sid, sid).when(is_guid, guids).when(is_oid, oid).when(is_dn, _is(dn, "DistinguishedName", _changed(dn, value)))
        .when(name.isin(*MULTI_FIELDS), _is(F.array_join(text.distinct_values(value), ", "), "MultiValue")).when(raw.startswith("%%"), resource)
        .otherwise(_is(value, "Text", "Unchanged"))
    )


def normalized_values(values: Column, type_: Column) -> Column:
    """A payload map with each value normalized; AttributeValue goes by its sibling that names the attribute."""
    sibling = lambda key: F.nullif(F.trim(F.get(F.map_values(F.map_filter(values, lambda k, _: F.lower(k) == key)), F.lit(0))), F.lit(""))
    attribute = F.coalesce(sibling("attributename"), sibling("attributeldapdisplayname"), F.lit(""))
    return F.transform_values(values, lambda k, v: normalized(k, v, attribute, type_))
