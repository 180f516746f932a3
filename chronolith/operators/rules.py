"""Detection rules: definitions, tuning, packs, and the built-in rules as data."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from chronolith.operators.predicates import Predicate, all_of, any_of, compare, from_json, to_json, validate

KINDS = ("Stateless", "Threshold", "DistinctValue", "Temporal", "OrderedTemporal", "Absence")
SEVERITIES = ("Informational", "Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class Selector:
    """Which rows a rule or a step looks at; an empty part takes any."""

    event_ids: tuple[int, ...] = ()
    types: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    predicate: Predicate | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str = ""
    kind: str = "Stateless"
    severity: str = "Medium"
    selector: Selector = Selector()
    threshold: int = 0
    window_seconds: float = 0.0
    group_by: str | None = None
    distinct_by: str | None = None
    steps: tuple[Selector, ...] = ()
    tags: tuple[str, ...] = ()
    enabled: bool = True
    confidence: int = 50  # from 0 to 100

    def check(self) -> None:
        """Raises ValueError where the rule is malformed."""
        if self.kind not in KINDS or self.severity not in SEVERITIES or not self.rule_id or not 0 <= self.confidence <= 100:
            raise ValueError(f"rule {self.rule_id!r}: kind {self.kind!r}, severity {self.severity!r}, confidence {self.confidence!r}")
        if self.kind in ("Threshold", "DistinctValue") and self.threshold < 2 or self.kind == "DistinctValue" and not self.distinct_by:
            raise ValueError(f"rule {self.rule_id}: a threshold of 2 at least, and the field that must differ")
        if self.kind != "Stateless" and self.window_seconds <= 0:
            raise ValueError(f"rule {self.rule_id}: a window is needed")
        if self.kind in ("Temporal", "OrderedTemporal") and len(self.steps) < 2 or self.kind == "Absence" and len(self.steps) != 2:
            raise ValueError(f"rule {self.rule_id}: {len(self.steps)} steps")
        for s in (self.selector, *self.steps):
            if s.predicate is not None:
                validate(s.predicate)


@dataclass(frozen=True)
class Suppression:
    """Rows that a rule must not see, from ``start`` to ``end``, both inclusive."""

    rule_id: str
    predicate: Predicate
    start: datetime | None = None
    end: datetime | None = None


@dataclass(frozen=True)
class Tuning:
    rule_id: str
    disabled: bool = False
    severity: str | None = None
    threshold: int | None = None


def tuned(rules: Sequence[Rule], tuning: Sequence[Tuning]) -> list[Rule]:
    """Rules after tuning; a threshold can only be set, to 2 or more, where the rule has one."""
    by_id = {t.rule_id.lower(): t for t in tuning}
    out = []
    for r in rules:
        t = by_id.get(r.rule_id.lower())
        if t is not None:
            if t.threshold is not None and (r.kind not in ("Threshold", "DistinctValue") or t.threshold < 2):
                raise ValueError(f"rule {r.rule_id} takes no threshold of {t.threshold}")
            r = replace(r, enabled=r.enabled and not t.disabled, severity=t.severity or r.severity, threshold=t.threshold or r.threshold)
        out.append(r)
    return out


def _selector_json(s: Selector) -> dict:
    return {**{k: list(v) for k, v in asdict(s).items() if k != "predicate"}, "predicate": None if s.predicate is None else json.loads(to_json(s.predicate))}


def rule_json(r: Rule) -> dict:
    d = {k: v for k, v in asdict(r).items() if k not in ("selector", "steps", "tags")}
    return {**d, "tags": list(r.tags), "selector": _selector_json(r.selector), "steps": [_selector_json(s) for s in r.steps]}


def rule_from_json(d: dict) -> Rule:
    def selector(x: dict) -> Selector:
        return Selector(*(tuple(x.get(k, ())) for k in ("event_ids", "types", "channels", "providers")), from_json(json.dumps(x["predicate"])) if x.get("predicate") else None)

    r = Rule(**{**d, "tags": tuple(d.get("tags", ())), "selector": selector(d.get("selector", {})), "steps": tuple(map(selector, d.get("steps", ())))})
    r.check()
    return r


def plan_hash(rules: Sequence[Rule], suppressions: Sequence[Suppression] = ()) -> str:
    """A hash of everything that decides findings, whatever the order of the rules."""
    parts = sorted(json.dumps(rule_json(r), sort_keys=True) for r in rules if r.enabled)
    parts += sorted(f"{s.rule_id}|{to_json(s.predicate)}|{s.start}|{s.end}" for s in suppressions)
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Pack:
    name: str
    version: str
    rules: tuple[Rule, ...] = field(default=())

    def content_hash(self) -> str:
        return plan_hash([replace(r, enabled=True) for r in self.rules])

    def to_json(self, key: bytes | None = None) -> str:
        """The pack with its content hash and, given a key, a signature of it."""
        made = {"name": self.name, "version": self.version, "rules": [rule_json(r) for r in self.rules], "content_hash": self.content_hash()}
        if key is not None:
            made["signature"] = hmac.new(key, self._signed(), hashlib.sha256).hexdigest()
        return json.dumps(made, indent=1, sort_keys=True)

    def _signed(self) -> bytes:
        return f"{self.name}\n{self.version}\n{self.content_hash()}".encode()

    @staticmethod
    def from_json(text: str, key: bytes | None = None) -> "Pack":
        d = json.loads(text)
        pack = Pack(d["name"], d["version"], tuple(map(rule_from_json, d["rules"])))
        if len({r.rule_id.lower() for r in pack.rules}) != len(pack.rules):
            raise ValueError("rule ids of a pack must differ")
        if d.get("content_hash") != pack.content_hash():
            raise ValueError("the pack's content does not match its hash")
        if key is not None and not hmac.compare_digest(d.get("signature", ""), hmac.new(key, pack._signed(), hashlib.sha256).hexdigest()):
            raise ValueError("the pack's signature is not valid")
        return pack


def compare_packs(old: Pack, new: Pack) -> dict[str, list[str]]:
    """Rule ids that were added, removed and changed."""
    a, b = ({r.rule_id: json.dumps(rule_json(r), sort_keys=True) for r in p.rules} for p in (old, new))
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


#: Confidence of the built-in rules, in order of their numbers; there is no ENDPOINT-0011.
_CONFIDENCE = {
    "EVENTING": (99, 95, 85, 90, 95, 75),
    "IDENTITY": (80, 75, 90, 85, 80, 80, 80, 90, 75),
    "AUTH": (95, 70, 65, 90, 90, 75, 95, 95, 90, 100),
    "GOVERNANCE": (90, 80, 95, 90, 85, 85, 90, 90),
    "ENDPOINT": (95, 80, 75, 70, 95, 75, 80, 85, 80, 80, None, 65),
}


def _sure(rule_id: str) -> int:
    family, number = rule_id.rsplit("-", 1)
    return _CONFIDENCE[family][int(number) - 1]


def _on(rule_id: str, title: str, severity: str, type_: str, *tags: str, predicate: Predicate | None = None) -> Rule:
    return Rule(rule_id, title, "Stateless", severity, Selector(types=(type_,), predicate=predicate), tags=tags, confidence=_sure(rule_id))


def _burst(rule_id: str, title: str, type_: str, threshold: int, seconds: int, *tags: str) -> Rule:
    return Rule(rule_id, title, "Threshold", "Medium", Selector(types=(type_,)), threshold, seconds, "ObjectAffected", tags=tags, confidence=_sure(rule_id))


_WEAK = any_of(compare("WeakEncryptionAlgorithm", "Equal", True), compare("WeakSessionKeyEncryptionAlgorithm", "Equal", True))

#: The built-in packs.
BUILT_IN = (
    Pack("eventing-integrity", "1.0.0", (
        _on("EVENTING-0001", "Security event log cleared", "Critical", "LogsClearedSecurity", "eventing-integrity", "attack.t1070.001"),
        _on("EVENTING-0002", "Security event log reached capacity", "High", "LogsFullSecurity", "eventing-integrity", "collection-gap"),
        _on("EVENTING-0003", "Audit policy changed", "High", "AuditPolicyChange", "eventing-integrity", "attack.t1562.002"),
        _on("EVENTING-0004", "Application or System event log cleared", "High", "LogsClearedOther", "eventing-integrity", "attack.t1070.001"),
        _on("EVENTING-0005", "Crash-on-audit-fail recovery occurred", "Critical", "OSCrashOnAuditFailRecovery", "eventing-integrity", "audit-failure"),
        _on("EVENTING-0006", "System time changed", "Medium", "OSTimeChange", "eventing-integrity", "attack.t1070.006"),
    )),
    Pack("identity-privilege", "1.0.0", (
        _on("IDENTITY-0001", "Privileged group membership changed", "High", "ADGroupMembershipChange", "active-directory", "privilege", "attack.t1098", predicate=compare("GroupName", "In", "Domain Admins", "Enterprise Admins", "Schema Admins", "Administrators")),
        _on("IDENTITY-0002", "Directory user SID history changed", "High", "ADUserCreateChange", "active-directory", "sid-history", "attack.t1134.005", predicate=all_of(compare("SidHistory", "IsNotNull"), compare("SidHistory", "NotEqual", ""))),
        _on("IDENTITY-0003", "User account lifecycle state changed", "Low", "ADUserStatus", "active-directory", "identity-lifecycle"),
        _on("IDENTITY-0004", "User right assignment changed", "High", "ADUserRightsAssignment", "active-directory", "privilege", "attack.t1098"),
        _on("IDENTITY-0005", "Special privileges assigned at logon", "Medium", "ADUserPrivilegeUse", "active-directory", "privileged-logon", "attack.t1078"),
        _on("IDENTITY-0006", "Active Directory group changed", "Medium", "ADGroupChange", "active-directory", "group-governance"),
        _on("IDENTITY-0007", "Audited object deleted", "Medium", "ObjectDeletion", "active-directory", "object-deletion"),
        _on("IDENTITY-0008", "Computer account deleted", "Medium", "ADComputerDeleted", "active-directory", "computer-lifecycle"),
        _burst("IDENTITY-0009", "Repeated account lockouts", "ADUserLockouts", 3, 900, "active-directory", "lockout", "attack.t1110"),
    )),
    Pack("authentication", "1.0.0", (
        _on("AUTH-0001", "NTLMv1 authentication observed", "Medium", "ADUserLogonNTLMv1", "authentication", "ntlmv1", "attack.t1557"),
        _burst("AUTH-0002", "Repeated failed logons by account", "ADUserLogonFailed", 5, 300, "authentication", "password-spray", "attack.t1110"),
        Rule("AUTH-0003", "Failed logon followed by successful logon", "OrderedTemporal", "Medium", window_seconds=600, group_by="ObjectAffected", steps=(Selector(types=("ADUserLogonFailed",)), Selector(types=("ADUserLogon", "ADUserLogonNTLMv1"))), tags=("authentication", "account-compromise", "attack.t1078"), confidence=_sure("AUTH-0003")),
        _on("AUTH-0004", "Weak Kerberos TGT or session-key encryption observed", "Medium", "KerberosTGTRequest", "authentication", "kerberos-weak-encryption", "attack.t1558", predicate=_WEAK),
        _on("AUTH-0005", "Weak Kerberos service-ticket or session-key encryption observed", "Medium", "KerberosServiceTicket", "authentication", "kerberos-weak-encryption", "attack.t1558", predicate=_WEAK),
        _burst("AUTH-0006", "Repeated Kerberos ticket failures", "KerberosTicketFailure", 5, 300, "authentication", "kerberos", "attack.t1110"),
        _on("AUTH-0007", "Unsigned or cleartext LDAP bind observed", "Medium", "ADLdapBindingDetails", "authentication", "ldap-signing", "attack.t1557"),
        _on("AUTH-0008", "SMB1 access observed", "High", "ADSMBServerAuditV1", "authentication", "smb1", "attack.t1021.002"),
        _on("AUTH-0009", "Kerberos policy changed", "High", "KerberosPolicyChange", "authentication", "kerberos-policy"),
        _on("AUTH-0010", "KDC reported an RC4 enforcement risk", "High", "KerberosKdcRc4Audit", "authentication", "kerberos-rc4-enforcement"),
    )),
    Pack("governance", "1.0.0", (
        _on("GOVERNANCE-0001", "Group Policy Object deleted", "High", "GpoDeleted", "group-policy", "governance"),
        _on("GOVERNANCE-0002", "Group Policy link changed", "Medium", "ADGroupPolicyLinks", "group-policy", "governance"),
        _on("GOVERNANCE-0003", "Certificate issued", "Informational", "CertificateIssued", "adcs", "certificate-services"),
        _on("GOVERNANCE-0004", "Group Policy Object created", "Low", "GpoCreated", "group-policy", "governance"),
        _on("GOVERNANCE-0005", "Group Policy Object modified", "Medium", "GpoModified", "group-policy", "governance"),
        _on("GOVERNANCE-0006", "Detailed Group Policy directory change", "Medium", "ADGroupPolicyChangesDetailed", "group-policy", "governance"),
        _on("GOVERNANCE-0007", "BitLocker protection suspended", "High", "BitLockerSuspended", "bitlocker", "security-control", "attack.t1562.001"),
        _on("GOVERNANCE-0008", "BitLocker recovery material changed", "Medium", "BitLockerKeyChange", "bitlocker", "key-governance"),
    )),
    Pack("endpoint-protection", "1.0.1", (
        _on("ENDPOINT-0001", "Microsoft Defender detected a threat", "High", "DefenderThreatDetected", "defender", "threat"),
        _on("ENDPOINT-0002", "Microsoft Defender configuration changed", "Medium", "DefenderConfigurationChanged", "defender", "configuration", "attack.t1562.001"),
        _on("ENDPOINT-0003", "Scheduled task created", "Medium", "ScheduledTaskCreated", "scheduled-task", "persistence", "attack.t1053.005"),
        _on("ENDPOINT-0004", "Firewall rule added", "Low", "FirewallRuleAdded", "firewall", "configuration"),
        _on("ENDPOINT-0005", "Microsoft Defender acted on a threat", "Medium", "DefenderThreatAction", "defender", "remediation"),
        _on("ENDPOINT-0006", "Scheduled task updated", "Medium", "ScheduledTaskUpdated", "scheduled-task", "persistence", "attack.t1053.005"),
        _on("ENDPOINT-0007", "Scheduled task enabled", "Low", "ScheduledTaskEnabled", "scheduled-task", "persistence", "attack.t1053.005"),
        _on("ENDPOINT-0008", "Scheduled task deleted", "Low", "ScheduledTaskDeleted", "scheduled-task", "defense-evasion"),
        _on("ENDPOINT-0009", "Firewall rule deleted", "Medium", "FirewallRuleDeleted", "firewall", "configuration"),
        _on("ENDPOINT-0010", "Packet-monitor driver service activity", "High", "NetworkMonitorDriverLoaded", "network", "driver-service"),
        _on("ENDPOINT-0012", "External device recognized", "Low", "DeviceRecognized", "device", "removable-media"),
    )),
)
