"""Decoders of flags, codes and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: User account control bits.
ACCOUNT_FLAGS = (
    (0x0001, "SCRIPT"),
    (0x0002, "ACCOUNTDISABLE"),
    (0x0008, "HOMEDIR_REQUIRED"),
    (0x0010, "LOCKOUT"),
    (0x0020, "PASSWD_NOTREQD"),
    (0x0040, "PASSWD_CANT_CHANGE"),
    (0x0080, "ENCRYPTED_TEXT_PWD_ALLOWED"),
    (0x0100, "TEMP_DUPLICATE_ACCOUNT"),
    (0x0200, "NORMAL_ACCOUNT"),
    (0x0800, "INTERDOMAIN_TRUST_ACCOUNT"),
    (0x1000, "WORKSTATION_TRUST_ACCOUNT"),
    (0x2000, "SERVER_TRUST_ACCOUNT"),
    (0x10000, "DONT_EXPIRE_PASSWORD"),
    (0x20000, "MNS_LOGON_ACCOUNT"),
    (0x40000, "SMARTCARD_REQUIRED"),
    (0x80000, "TRUSTED_FOR_DELEGATION"),
    (0x100000, "NOT_DELEGATED"),
    (0x200000, "USE_DES_KEY_ONLY"),
    (0x400000, "DONT_REQ_PREAUTH"),
    (0x800000, "PASSWORD_EXPIRED"),
    (0x1000000, "TRUSTED_TO_AUTH_FOR_DELEGATION"),
    (0x04000000, "PARTIAL_SECRETS_ACCOUNT"),
)
#: Logon types.
LOGON_TYPES = ((0, "System"), (2, "Interactive"), (3, "Network"), (4, "Batch"), (5, "Service"), (7, "Unlock"), (8, "NetworkCleartext"), (9, "NewCredentials"), (10, "RemoteInteractive"), (11, "CachedInteractive"), (12, "CachedRemoteInteractive"), (13, "CachedUnlock"))
#: Kerberos encryption types.
ENCRYPTION_TYPES = ((0x1, "DES-CBC-CRC"), (0x3, "DES-CBC-MD5"), (0x11, "AES128-CTS-HMAC-SHA1-96"), (0x12, "AES256-CTS-HMAC-SHA1-96"), (0x17, "RC4-HMAC"), (0x18, "RC4-HMAC-EXP"))

#: Kerberos ticket options.
TICKET_OPTIONS = (
    (0x00000001, "Validate"), (0x00000002, "Renew"), (0x00000008, "EncTicketInSessionKey"), (0x00000010, "RenewableOk"), (0x00010000, "Canonicalize"), (0x00020000, "Anonymous"), (0x00040000, "OkAsDelegate"), (0x00080000, "TransitPolicyChecked"),
    (0x00100000, "HwAuthenticated"), (0x00200000, "PreAuthenticated"), (0x00400000, "Initial"), (0x00800000, "Renewable"), (0x01000000, "Invalid"), (0x02000000, "Postdated"), (0x04000000, "AllowPostdate"), (0x08000000, "Proxy"),
    (0x10000000, "Proxiable"), (0x20000000, "Forwarded"), (0x40000000, "Forwardable"),
)
#: Kerberos pre-authentication types.
PRE_AUTH_TYPES = ((0, "None"), (2, "PA-ENC-TIMESTAMP"), (11, "PA-ETYPE-INFO"), (15, "PA-PK-AS-REP_OLD"), (16, "PA-PK-AS-REQ"), (17, "PA-PK-AS-REP"), (19, "PA-ETYPE-INFO2"), (20, "PA-SVR-REFERRAL-INFO"), (138, "PA-ENCRYPTED-CHALLENGE"))
#: Bits of a supported-encryption mask that mean AES, and the one that means RC4.
AES_BITS, RC4_BIT = 0x8 | 0x10 | 0x20 | 0x40 | 0x80, 0x4
#: Logon status codes.
STATUS_CODES = (
    (0x0, "STATUS_SUCCESS"), (0xC000005E, "STATUS_NO_LOGON_SERVERS"), (0xC0000064, "STATUS_NO_SUCH_USER"), (0xC000006A, "STATUS_WRONG_PASSWORD"), (0xC000006D, "STATUS_LOGON_FAILURE"), (0xC000006E, "STATUS_ACCOUNT_RESTRICTION"),
    (0xC000006F, "STATUS_INVALID_LOGON_HOURS"), (0xC0000070, "STATUS_INVALID_WORKSTATION"), (0xC0000071, "STATUS_PASSWORD_EXPIRED"), (0xC0000072, "STATUS_ACCOUNT_DISABLED"), (0xC0000133, "STATUS_TIME_DIFFERENCE_AT_DC"),
    (0xC000015B, "STATUS_LOGON_TYPE_NOT_GRANTED"), (0xC0000193, "STATUS_ACCOUNT_EXPIRED"), (0xC0000224, "STATUS_PASSWORD_MUST_CHANGE"), (0xC0000234, "STATUS_ACCOUNT_LOCKED_OUT"), (0xC0000413, "STATUS_AUTHENTICATION_FIREWALL_FAILED"),
)
#: Answers and impersonation levels by resource identifier.
YES_NO = (("%%1842", "Yes"), ("%%1843", "No"))
IMPERSONATION_LEVELS = (("%%1831", "Anonymous"), ("%%1832", "Identification"), ("%%1833", "Impersonation"), ("%%1840", "Delegation"))
#: Resource codes of a logon's failure and of a virtual account's answer.
FAILURE_REASONS = ((0, "None"), (2304, "UnknownUserNameOrBadPassword"), (2305, "AccountRestrictions"), (2306, "AccountExpired"), (2307, "AccountLockedOut"), (2308, "PasswordExpired"), (2309, "LogonTypeNotGranted"))
VIRTUAL_ACCOUNT = ((1843, "Yes"), (1844, "No"))
#: Volume encryption protectors and volumes.
PROTECTORS = ((2200, "Tpm"), (2201, "ExternalKey"), (2202, "NumericalPassword"), (2203, "TpmPin"), (2204, "TpmStartupKey"), (2205, "TpmPinAndStartupKey"), (2206, "Passphrase"), (2207, "RecoveryKey"))
VOLUMES = ((810, "OperatingSystemVolume"), (811, "FixedDataVolume"), (812, "RemovableDataVolume"))
#: Network access port types, from 0 on.
PORT_TYPES = tuple(enumerate((
    "Async", "Sync", "ISDN", "ISDNV120", "ISDNV110", "Virtual", "PIAFS", "HdlcClearChannel", "X25", "X75", "G3Fax", "SDSL", "ADSLCAP", "ADSLDMT", "IDSL", "Ethernet", "XDSL", "Cable", "WirelessOther", "WirelessIEEE80211", "TokenRing", "FDDI",
    "WirelessCDMA", "WirelessCDPD", "WirelessIDEN", "Wireless1XEV", "IAPP", "FTTP",
)))
#: Hardware vendors by USB id.
VENDORS = (("045E", "Microsoft"), ("046D", "Logitech"), ("0781", "SanDisk"), ("05AC", "Apple"), ("0BDA", "Realtek"))
#: Privileges and logon rights by constant.
PRIVILEGES = (
    ("SeTrustedCredManAccessPrivilege", "Access Credential Manager as a trusted caller"), ("SeNetworkLogonRight", "Access this computer from the network"), ("SeTcbPrivilege", "Act as part of the operating system"),
    ("SeMachineAccountPrivilege", "Add workstations to domain"), ("SeIncreaseQuotaPrivilege", "Adjust memory quotas for a process"), ("SeInteractiveLogonRight", "Allow log on locally"),
    ("SeRemoteInteractiveLogonRight", "Allow log on through Remote Desktop Services"), ("SeBackupPrivilege", "Back up files and directories"), ("SeChangeNotifyPrivilege", "Bypass traverse checking"),
    ("SeSystemtimePrivilege", "Change the system time"), ("SeTimeZonePrivilege", "Change the time zone"), ("SeCreatePagefilePrivilege", "Create a pagefile"), ("SeCreateTokenPrivilege", "Create a token object"),
    ("SeCreateGlobalPrivilege", "Create global objects"), ("SeCreatePermanentPrivilege", "Create permanent shared objects"), ("SeCreateSymbolicLinkPrivilege", "Create symbolic links"), ("SeDebugPrivilege", "Debug programs"),
    ("SeDenyNetworkLogonRight", "Deny access to this computer from the network"), ("SeDenyBatchLogonRight", "Deny log on as a batch job"), ("SeDenyServiceLogonRight", "Deny log on as a service"), ("SeDenyInteractiveLogonRight", "Deny log on locally"),
    ("SeDenyRemoteInteractiveLogonRight", "Deny log on through Remote Desktop Services"), ("SeEnableDelegationPrivilege", "Enable computer and user accounts to be trusted for delegation"), ("SeRemoteShutdownPrivilege", "Force shutdown from a remote system"),
    ("SeAuditPrivilege", "Generate security audits"), ("SeImpersonatePrivilege", "Impersonate a client after authentication"), ("SeIncreaseWorkingSetPrivilege", "Increase a process working set"), ("SeIncreaseBasePriorityPrivilege", "Increase scheduling priority"),
    ("SeLoadDriverPrivilege", "Load and unload device drivers"), ("SeLockMemoryPrivilege", "Lock pages in memory"), ("SeBatchLogonRight", "Log on as a batch job"), ("SeServiceLogonRight", "Log on as a service"),
    ("SeSecurityPrivilege", "Manage auditing and security log"), ("SeRelabelPrivilege", "Modify an object label"), ("SeSystemEnvironmentPrivilege", "Modify firmware environment values"), ("SeManageVolumePrivilege", "Perform volume maintenance tasks"),
    ("SeProfileSingleProcessPrivilege", "Profile single process"), ("SeSystemProfilePrivilege", "Profile system performance"), ("SeUndockPrivilege", "Remove computer from docking station"), ("SeAssignPrimaryTokenPrivilege", "Replace a process level token"),
    ("SeRestorePrivilege", "Restore files and directories"), ("SeShutdownPrivilege", "Shut down the system"), ("SeSyncAgentPrivilege", "Synchronize directory service data"), ("SeTakeOwnershipPrivilege", "Take ownership of files or other objects"),
)
#: Directory operations by resource identifier.
OPERATIONS = (("%%14674", "Value Added"), ("%%14675", "Value Deleted"), ("%%14676", "Unknown"))
#: Names of status codes by family.
WIN32_NAMES = (
    (0, "ERROR_SUCCESS"), (2, "ERROR_FILE_NOT_FOUND"), (3, "ERROR_PATH_NOT_FOUND"), (5, "ERROR_ACCESS_DENIED"), (32, "ERROR_SHARING_VIOLATION"), (53, "ERROR_BAD_NETPATH"), (67, "ERROR_BAD_NET_NAME"), (87, "ERROR_INVALID_PARAMETER"),
    (112, "ERROR_DISK_FULL"), (121, "ERROR_SEM_TIMEOUT"), (122, "ERROR_INSUFFICIENT_BUFFER"), (126, "ERROR_MOD_NOT_FOUND"), (193, "ERROR_BAD_EXE_FORMAT"), (267, "ERROR_DIRECTORY"),
)
INSTALLER_NAMES = (
    (0, "ERROR_SUCCESS"), (1601, "ERROR_INSTALL_SERVICE_FAILURE"), (1602, "ERROR_INSTALL_USEREXIT"), (1603, "ERROR_INSTALL_FAILURE"), (1605, "ERROR_UNKNOWN_PRODUCT"), (1612, "ERROR_INSTALL_SOURCE_ABSENT"), (1618, "ERROR_INSTALL_ALREADY_RUNNING"),
    (1619, "ERROR_INSTALL_PACKAGE_OPEN_FAILED"), (1620, "ERROR_INSTALL_PACKAGE_INVALID"), (1622, "ERROR_INSTALL_LOG_FAILURE"), (1625, "ERROR_INSTALL_PACKAGE_REJECTED"), (1638, "ERROR_PRODUCT_VERSION"), (1641, "ERROR_SUCCESS_REBOOT_INITIATED"), (3010, "ERROR_SUCCESS_REBOOT_REQUIRED"),
)
HRESULT_NAMES = ((0, "S_OK"), (1, "S_FALSE"), (0x80004004, "E_ABORT"), (0x80004005, "E_FAIL"))


def flags(value: Column, table: tuple[tuple[int, str], ...] = ACCOUNT_FLAGS) -> Column:
    """Names of the set bits, by rising bit; bits without a name come last as one ``UNKNOWN_0x..``."""
    v = value.cast("long")
    named = F.filter(F.array(*[F.when(v.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in table]), lambda x: x.isNotNull())
    known = sum(bit for bit, _ in table)
    rest = v.bitwiseAND(F.lit(~known & (1 << 63) - 1))
    return F.when(v.isNotNull(), F.when(rest != 0, F.concat(named, F.array(F.concat(F.lit("UNKNOWN_0x"), F.hex(rest))))).otherwise(named))


def integer(text: Column) -> Column:
    """A decimal or 0x-prefixed hexadecimal number; null if malformed."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike(r"^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("long")).when(t.rlike(r"^[+-]?\d{1,18}$"), t.try_cast("long"))


def name_of(code: Column, table: tuple[tuple[int, str], ...]) -> Column:
    """The name of a code; null if it has none."""
    known = F.create_map(*[c for k, v in table for c in (F.lit(k).cast("long"), F.lit(v))])
    return F.element_at(known, code.cast("long"))


def mask_matches(value: Column, *masks: int) -> Column:
    """Whether any bit of the masks, put together, is set."""
    every = 0
    for m in masks:
        every |= m
    return F.coalesce(value.cast("long").bitwiseAND(F.lit(every)) != 0, F.lit(False))


def weak_encryption(code: Column) -> Column:
    """Whether a Kerberos encryption type is DES or RC4."""
    return F.coalesce(code.cast("int").isin(1, 3, 23, 24), F.lit(False))


def guid(text: Column) -> Column:
    """A GUID in lower case with dashes; null if malformed."""
    t = F.lower(F.regexp_replace(F.trim(text), r"^[{(]|[)}]$", ""))
    plain = F.regexp_replace(t, r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    return F.when(plain.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), plain)


def kind_of(text: Column) -> Column:
    """What a value is, by the first shape that fits."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^%%\d+$"), "ResourceIdentifier").when(t.rlike(r"^(?i)S-1-\d+(-\d+)+$"), "SecurityIdentifier").when(guid(t).isNotNull(), "Guid")
        .when(t.rlike(r"^(?i)(CN|OU|DC)=[^,]+(,\s*(CN|OU|DC)=[^,]+)*$"), "DistinguishedName").when(t.rlike(r"^[0-2](\.\d+){2,}$"), "ObjectIdentifier")
        .when(t.rlike(r"[\n;]"), "MultiValue").when(t.isNotNull(), "Text").otherwise("Unknown")
    )


def distinguished_name(text: Column) -> Column:
    """A distinguished name without spaces around its separators, which become commas."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*(?<!\\)[,;]\s*", ","), r"\s*=\s*", "=")


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    shape = r"^(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"
    part = lambda n: F.regexp_extract(text, shape, n).cast("long")
    return F.when(text.rlike(shape), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ipv6_halves(text: Column) -> tuple[Column, Column]:
    """An IPv6 address as two longs whose signed order is that of the address; null if it is none.

    A ``::`` stands for the zero groups that are missing; the last 32 bits may be written as IPv4.
    """
    v4 = ipv4_number(F.regexp_extract(text, r"((?:\d+\.){3}\d+)$", 1))
    tail = F.concat(F.lower(F.hex(F.floor(v4 / 65536).cast("long"))), F.lit(":"), F.lower(F.hex(F.pmod(v4, F.lit(65536)))))
    plain = F.lower(F.when(text.contains("."), F.concat(F.regexp_extract(text, r"^(.*:)(?:\d+\.){3}\d+$", 1), tail)).otherwise(text))
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")
    twice = F.size(F.split(plain, "::"))
    left, right = groups(F.get(F.split(plain, "::"), F.lit(0))), groups(F.coalesce(F.get(F.split(plain, "::"), F.lit(1)), F.lit("")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    whole = F.transform(F.when(twice == 2, F.concat(left, zeros, right)).otherwise(left), lambda g: F.lpad(g, 4, "0"))
    shape = plain.rlike(r"^[0-9a-f:]+$") & ~plain.rlike(r"[0-9a-f]{5}|:::|^:[^:]|[^:]:$") & (twice <= 2) & (F.size(whole) == 8) & ((twice == 1) | (F.size(left) + F.size(right) < 8))

    def half(start: int) -> Column:
        text_ = F.array_join(F.slice(whole, start, 4), "")
        upper, lower = F.conv(F.substring(text_, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text_, 9, 8), 16, 10).cast("long")
        return F.when(F.coalesce(shape, F.lit(False)), (upper - F.lit(1 << 31).cast("long")) * F.lit(1 << 32).cast("long") + lower)

    return half(1), half(5)


def operation(text: Column) -> Column:
    """The directory operation of a resource identifier or of its name, whatever its case; null if it is none."""
    t = F.upper(F.trim(text))
    return F.coalesce(*[F.when(t.isin(code, name.upper()), name) for code, name in OPERATIONS])


def resource(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The name behind a resource identifier or another text code; null if the table has none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table for x in pair]), F.trim(text))


def privilege(constant: Column) -> Column:
    """What a privilege or logon right allows; a constant that is unknown stays."""
    return F.coalesce(resource(constant, PRIVILEGES), constant)


def device_type(class_name: Column) -> Column:
    """A plain name for a device class; a class without one stays."""
    has = lambda *words: F.coalesce(F.upper(class_name).rlike("|".join(words)), F.lit(False))
    return F.when(F.upper(class_name) == "DISKDRIVE", "Disk Drive").when(has("USB"), "USB Device").when(has("NETWORK"), "Network Adapter").when(has("IMAGE", "CAMERA"), "Imaging Device").otherwise(class_name)


def vendor(device_id: Column) -> Column:
    """The vendor of a device id with ``VID_xxxx``; null if it is unknown."""
    return resource(F.upper(F.regexp_extract(device_id, "(?i)vid_([0-9a-f]{4})", 1)), VENDORS)


def supports_aes(mask: Column) -> Column:
    """Whether a supported-encryption mask has AES; null without a mask."""
    return mask.cast("long").bitwiseAND(F.lit(AES_BITS)) != 0


def supports_rc4(mask: Column) -> Column:
    """Whether a supported-encryption mask has RC4; null without a mask."""
    return mask.cast("long").bitwiseAND(F.lit(RC4_BIT)) != 0


def policy_links(text: Column) -> Column:
    """(distinguished_name, guid, options, enabled, enforced) of the policy links ``[LDAP://dn;options]`` in order."""
    shape = r"\[LDAP://([^;]+);(\d+)\]"

    def link(x: Column) -> Column:
        dn, options = F.regexp_extract(x, shape, 1), F.coalesce(F.regexp_extract(x, shape, 2).try_cast("int"), F.lit(0))
        guid_ = F.nullif(F.regexp_extract(dn, r"(?i)cn=\{([0-9a-f-]+)\}", 1), F.lit(""))
        return F.struct(dn.alias("distinguished_name"), guid_.alias("guid"), options.alias("options"), (options.bitwiseAND(1) == 0).alias("enabled"), (options.bitwiseAND(2) != 0).alias("enforced"))

    return F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), link)


def diagnostic_code(text: Column, kind: str = "Unknown") -> Column:
    """(value, hex, facility, failure, win32, outcome, symbol) of a 32-bit number read as Win32, HResult, WindowsInstaller, ProcessExit or Unknown.

    Signed and unsigned decimals and 0x-hexadecimals are read; what a number means comes
    from its declared family only. All but outcome are null where there is none.
    """
    given = F.lower(F.trim(text))
    number = F.when(given.rlike(r"^0x[0-9a-f]{1,8}$"), F.conv(F.substring(given, 3, 8), 16, 10).cast("long")).when(given.rlike(r"^[+-]?\d{1,10}$"), given.cast("long"))
    value = F.when(number.between(0, 0xFFFFFFFF), number).when(number.between(-0x80000000, -1), number + 0x100000000)
    none = lambda t: F.lit(None).cast(t)
    h = kind == "HResult"
    failed = value >= 0x80000000
    inner = F.when(F.shiftrightunsigned(value, 16) == 0x8007, value.bitwiseAND(F.lit(0xFFFF).cast("long")))
    if h:
        outcome = F.when(failed, "Failure").when(value.isNotNull(), "Success")
        symbol = F.coalesce(name_of(value, HRESULT_NAMES), F.when(inner != 0, F.concat(F.lit("HRESULT_FROM_WIN32("), name_of(inner, WIN32_NAMES), F.lit(")"))))
    elif kind in ("Win32", "WindowsInstaller"):
        outcome = F.when(value == 0, "Success").when(value.isNotNull(), "Failure")
        if kind == "WindowsInstaller":
            outcome = F.when(value == 1641, "SuccessRestartInitiated").when(value == 3010, "SuccessRestartRequired").otherwise(outcome)
        symbol = name_of(value, WIN32_NAMES if kind == "Win32" else INSTALLER_NAMES)
    elif kind in ("Unknown", "ProcessExit"):
        outcome = symbol = none("string")
    else:
        raise ValueError(f"no family {kind!r}")
    return F.struct(
        value.alias("value"), F.concat(F.lit("0x"), F.lpad(F.hex(value), 8, "0")).alias("hex"), (F.shiftrightunsigned(value, 16).bitwiseAND(F.lit(0x1FFF).cast("long")).cast("int") if h else none("int")).alias("facility"),
        (failed if h else none("boolean")).alias("failure"), (inner if h else none("bigint")).alias("win32"), F.coalesce(outcome, F.lit("Unknown")).alias("outcome"), symbol.alias("symbol"),
    )
