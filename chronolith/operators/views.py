"""Typed event views: a log, event ids, providers and a row condition each; composites of them; user-defined ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import decode, text
from chronolith.operators.predicates import Predicate, all_of, any_of, compare, compile_predicate
from chronolith.schema import payload

_SEC, _SYS, _APP = "Security", "System", "Application"
_AUDIT = ("Microsoft-Windows-Security-Auditing",)
_LOG = ("Microsoft-Windows-Eventlog",)
_SYNC = ("Directory Synchronization",)
_SCM = ("Service Control Manager",)
_IIS = ("Microsoft-Windows-IIS-W3SVC", "W3SVC")
_BITLOCKER = ("Microsoft-Windows-BitLocker/BitLocker Management", ("Microsoft-Windows-BitLocker-API",))
_DEFENDER = ("Microsoft-Windows-Windows Defender/Operational", ("Microsoft-Windows-Windows Defender",))
_HYPERV = ("Microsoft-Windows-Hyper-V-Worker-Admin", ("Microsoft-Windows-Hyper-V-Worker",))
_PERF = ("Microsoft-Windows-Diagnostics-Performance/Operational", ("Microsoft-Windows-Diagnostics-Performance",))
_DIRECTORY = ("Directory Service", ("Microsoft-Windows-ActiveDirectory_DomainService",))
_GP_CLIENT = (
    "Group Policy Applications", "Group Policy Client", "Group Policy Data Sources", "Group Policy Device Settings", "Group Policy Drive Maps", "Group Policy Environment", "Group Policy Files", "Group Policy Folder Options",
    "Group Policy Folders", "Group Policy Ini Files", "Group Policy Internet Settings", "Group Policy Local Users and Groups", "Group Policy Mail Profiles", "Group Policy Network Options", "Group Policy Network Shares", "Group Policy Power Options",
    "Group Policy Printers", "Group Policy Regional Options", "Group Policy Registry", "Group Policy Scheduled Tasks", "Group Policy Services", "Group Policy Shortcuts", "Group Policy Standard Edition", "Group Policy Start Menu Settings",
)

#: Name, log, event ids, providers (none: any).
LEAVES = (
    ("ADComputerCreateChange", _SEC, (4741, 4742), _AUDIT),
    ("ADComputerDeleted", _SEC, (4743,), _AUDIT),
    ("ADComputerChangeDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("ADGroupMembershipChange", _SEC, (4728, 4729, 4732, 4733, 4746, 4747, 4751, 4752, 4756, 4757, 4761, 4762, 4785, 4786, 4787, 4788), _AUDIT),
    ("ADGroupEnumeration", _SEC, (4798, 4799), _AUDIT),
    ("ADGroupChange", _SEC, (4735, 4737, 4745, 4750, 4760, 4764, 4784, 4791), _AUDIT),
    ("ADGroupCreateDelete", _SEC, (4727, 4730, 4731, 4734, 4744, 4748, 4749, 4753, 4754, 4758, 4759, 4763), _AUDIT),
    ("ADGroupChangeDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("ADGroupPolicyChanges", _SEC, (5136, 5137, 5141), _AUDIT),
    ("ADGroupPolicyEdits", _SEC, (5136, 5137, 5141), _AUDIT),
    ("ADGroupPolicyLinks", _SEC, (5136, 5137, 5141), _AUDIT),
    ("ADGroupPolicyChangesDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("GpoCreated", _SEC, (5137,), _AUDIT),
    ("GpoDeleted", _SEC, (5141,), _AUDIT),
    ("GpoModified", _SEC, (5136,), _AUDIT),
    ("ADLdapBindingSummary", _DIRECTORY[0], (2887,), _DIRECTORY[1]),
    ("ADLdapBindingDetails", _DIRECTORY[0], (2889,), _DIRECTORY[1]),
    ("ADUserCreateChange", _SEC, (4720, 4738), _AUDIT),
    ("ADUserStatus", _SEC, (4722, 4725, 4723, 4724, 4726), _AUDIT),
    ("ADUserChangeDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("ADUserLockouts", _SEC, (4740,), _AUDIT),
    ("ADUserLogon", _SEC, (4624,), _AUDIT),
    ("ADUserLogonNTLMv1", _SEC, (4624,), _AUDIT),
    ("ADUserLogonFailed", _SEC, (4625,), _AUDIT),
    ("ADUserUnlocked", _SEC, (4767,), _AUDIT),
    ("ADUserPrivilegeUse", _SEC, (4672,), _AUDIT),
    ("ADUserRightsAssignment", _SEC, (4704, 4705), _AUDIT),
    ("KerberosTGTRequest", _SEC, (4768,), _AUDIT),
    ("KerberosServiceTicket", _SEC, (4769, 4770), _AUDIT),
    ("KerberosTicketFailure", _SEC, (4771, 4772), _AUDIT),
    ("KerberosPolicyChange", _SEC, (4713,), _AUDIT),
    ("ADOrganizationalUnitChangeDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("ADOtherChangeDetailed", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("ADSMBServerAuditV1", "Microsoft-Windows-SMBServer/Audit", (3000,), ("Microsoft-Windows-SMBServer",)),
    ("LogsClearedSecurity", _SEC, (1102,), _LOG),
    ("LogsClearedOther", _SYS, (104,), _LOG),
    ("LogsFullSecurity", _SEC, (1104,), _LOG),
    ("NetworkAccessAuthenticationPolicy", _SEC, (6272, 6273), _AUDIT),
    ("CertificateIssued", _SEC, (4887,), _AUDIT),
    ("AuditPolicyChange", _SEC, (4719,), _AUDIT),
    ("FirewallRuleChange", _SEC, (4947,), _AUDIT),
    ("DhcpLeaseCreated", "Microsoft-Windows-DHCP Server/Operational", (10,), ()),
    ("BitLockerKeyChange", _BITLOCKER[0], (775, 776, 784, 828, 845, 897), _BITLOCKER[1]),
    ("BitLockerSuspended", _BITLOCKER[0], (773,), _BITLOCKER[1]),
    ("DeviceRecognized", _SEC, (6416,), _AUDIT),
    ("DeviceDisabled", _SEC, (6420,), _AUDIT),
    ("ObjectDeletion", _SEC, (4660,), _AUDIT),
    ("ScheduledTaskDeleted", _SEC, (4699,), _AUDIT),
    ("ScheduledTaskCreated", _SEC, (4698,), _AUDIT),
    ("OSCrash", _SYS, (6008,), ("EventLog", "Microsoft-Windows-Eventlog")),
    ("OSBugCheck", _SYS, (1001,), ("Microsoft-Windows-WER-SystemErrorReporting", "BugCheck")),
    ("OSStartup", _SYS, (12,), ("Microsoft-Windows-Kernel-General",)),
    ("OSShutdown", _SYS, (13,), ("Microsoft-Windows-Kernel-General",)),
    ("OSUncleanShutdown", _SYS, (41,), ("Microsoft-Windows-Kernel-Power",)),
    ("OSStartupSecurity", _SEC, (4608,), _AUDIT),
    ("OSCrashOnAuditFailRecovery", _SEC, (4621,), _AUDIT),
    ("OSTimeChange", _SEC, (4616,), _AUDIT),
    ("WindowsUpdateFailure", _SYS, (20,), ("Microsoft-Windows-WindowsUpdateClient",)),
    ("ClientGroupPoliciesApplication", _APP, (4098,), _GP_CLIENT),
    ("ClientGroupPoliciesSystem", _SYS, (1085,), ("Microsoft-Windows-GroupPolicy",)),
    ("HyperVVirtualMachineShutdown", _HYPERV[0], (18502,), _HYPERV[1]),
    ("HyperVVirtualMachineStarted", _HYPERV[0], (18500,), _HYPERV[1]),
    ("IISSiteBindingFailure", _SYS, (1007,), _IIS),
    ("HyperVCheckpointCreated", "Microsoft-Windows-Hyper-V-VMMS/Admin", (4096,), ()),
    ("IISSiteStopped", _SYS, (1005,), _IIS),
    ("ExchangeDatabaseMounted", _APP, (9526,), ()),
    ("DfsReplicationError", "DFS Replication", (5002,), ("DFSR",)),
    ("SqlDatabaseCreated", _APP, (17137, 1802), ()),
    ("SyncCompleted", _APP, (907,), _SYNC),
    ("AADConnectStagingEnabled", _APP, (350,), _SYNC),
    ("AADConnectStagingDisabled", _APP, (351,), _SYNC),
    ("AADConnectPasswordSyncFailed", _APP, (611,), _SYNC),
    ("AADConnectRunProfile", _APP, (906,), _SYNC),
    ("AADSyncCycleStage", _APP, (904,), _SYNC),
    ("AADSyncProvisionCredentialsPing", _APP, (653, 654), _SYNC),
    ("AADSyncPasswordHashSyncStatus", _APP, (663,), _SYNC),
    ("AADSyncImportStatus", _APP, (105, 132, 133, 134), _SYNC),
    ("AADSyncFilterStatus", _APP, (6952,), ("ADSync",)),
    ("NetworkMonitorDriverLoaded", _SYS, (7035, 7045), _SCM),
    ("NetworkPromiscuousMode", _SYS, (10400, 10401), ()),
    ("ScheduledTaskEnabled", _SEC, (4700,), _AUDIT),
    ("ScheduledTaskDisabled", _SEC, (4701,), _AUDIT),
    ("ScheduledTaskUpdated", _SEC, (4702,), _AUDIT),
    ("FirewallRuleAdded", _SEC, (4946,), _AUDIT),
    ("FirewallRuleDeleted", _SEC, (4948,), _AUDIT),
    ("DefenderThreatDetected", _DEFENDER[0], (1116,), _DEFENDER[1]),
    ("DefenderThreatAction", _DEFENDER[0], (1117,), _DEFENDER[1]),
    ("DefenderConfigurationChanged", _DEFENDER[0], (5007,), _DEFENDER[1]),
    ("GroupPolicyDirectoryAudit", _SEC, (5136, 5137, 5139, 5141), _AUDIT),
    ("KerberosKdcRc4Audit", _SYS, (201, 202, 203, 204, 205, 206, 207, 208, 209), ("Kdcsvc",)),
    ("ApplicationCrash", _APP, (1000,), ("Application Error",)),
    ("ApplicationHang", _APP, (1002,), ("Application Hang",)),
    ("ServiceFailure", _SYS, (7000, 7009, 7023, 7031, 7034), _SCM),
    ("DiskError", _SYS, (7, 51, 153), ("disk",)),
    ("FileSystemError", _SYS, (55, 98), ("Ntfs", "Microsoft-Windows-Ntfs")),
    ("StorageReset", _SYS, (129,), ("stornvme",)),
    ("HardwareError", _SYS, (17, 18, 19, 47), ("Microsoft-Windows-WHEA-Logger",)),
    ("DisplayDriverReset", _SYS, (4101,), ("Display",)),
    ("BootPerformance", _PERF[0], (100,), _PERF[1]),
    ("ShutdownPerformance", _PERF[0], (200,), _PERF[1]),
    ("StartupDegradation", _PERF[0], tuple(range(101, 111)), _PERF[1]),
    ("ShutdownDegradation", _PERF[0], (203,), _PERF[1]),
)
#: Views whose source is documented as unavailable; they never match.
UNAVAILABLE = ("DhcpLeaseCreated", "HyperVCheckpointCreated", "SqlDatabaseCreated", "AADConnectRunProfile", "NetworkPromiscuousMode")
#: Unions of views.
COMPOSITES = {
    "ActiveDirectoryAuthentication": ("ADUserLogon", "ADUserLogonFailed", "ADUserLogonNTLMv1", "ADUserLockouts", "ADUserUnlocked", "ADUserPrivilegeUse", "KerberosActivity"),
    "ActiveDirectoryAccountLifecycle": ("ADUserCreateChange", "ADUserStatus", "ADUserChangeDetailed", "ADGroupMembershipChange", "ADGroupChange", "ADGroupCreateDelete", "ADGroupChangeDetailed", "ADComputerCreateChange", "ADComputerDeleted", "ADComputerChangeDetailed", "ADOrganizationalUnitChangeDetailed", "ADOtherChangeDetailed"),
    "ActiveDirectoryChanges": ("ActiveDirectoryAccountLifecycle", "GroupPolicyActivity", "ADUserRightsAssignment", "AuditPolicyChange"),
    "GroupPolicyActivity": ("ADGroupPolicyChanges", "ADGroupPolicyEdits", "ADGroupPolicyLinks", "ADGroupPolicyChangesDetailed", "GpoCreated", "GpoDeleted", "GpoModified", "ClientGroupPoliciesApplication", "ClientGroupPoliciesSystem"),
    "KerberosActivity": ("KerberosTGTRequest", "KerberosServiceTicket", "KerberosTicketFailure", "KerberosPolicyChange", "KerberosKdcRc4Audit"),
    "AuthenticationHealth": ("ADUserLogonNTLMv1", "KerberosTGTRequest", "KerberosServiceTicket", "KerberosKdcRc4Audit", "ADLdapBindingSummary", "ADLdapBindingDetails"),
    "ScheduledTaskActivity": ("ScheduledTaskCreated", "ScheduledTaskDeleted", "ScheduledTaskEnabled", "ScheduledTaskDisabled", "ScheduledTaskUpdated"),
    "FirewallRuleActivity": ("FirewallRuleAdded", "FirewallRuleChange", "FirewallRuleDeleted"),
    "DefenderSecurity": ("DefenderThreatDetected", "DefenderThreatAction", "DefenderConfigurationChanged"),
    "OperatingSystemLifecycle": ("OSStartup", "OSStartupSecurity", "OSShutdown", "OSUncleanShutdown", "OSCrash", "OSBugCheck", "OSCrashOnAuditFailRecovery", "OSTimeChange"),
    "WindowsSecurityChanges": ("AuditPolicyChange", "FirewallRuleActivity", "DefenderSecurity", "BitLockerKeyChange", "BitLockerSuspended", "DeviceDisabled", "DeviceRecognized", "ObjectDeletion", "ScheduledTaskActivity", "LogsClearedSecurity", "LogsClearedOther", "LogsFullSecurity"),
    "EntraConnectHealth": ("AADConnectStagingEnabled", "AADConnectStagingDisabled", "AADConnectPasswordSyncFailed", "AADConnectRunProfile", "AADSyncCycleStage", "AADSyncProvisionCredentialsPing", "AADSyncPasswordHashSyncStatus", "AADSyncImportStatus", "AADSyncFilterStatus", "SyncCompleted"),
    "NetworkSecurity": ("NetworkAccessAuthenticationPolicy", "FirewallRuleActivity", "ADSMBServerAuditV1", "NetworkMonitorDriverLoaded", "NetworkPromiscuousMode", "DhcpLeaseCreated"),
    "InfrastructureHealth": ("OperatingSystemLifecycle", "WindowsUpdateFailure", "DfsReplicationError", "HyperVVirtualMachineStarted", "HyperVVirtualMachineShutdown", "HyperVCheckpointCreated", "IISSiteBindingFailure", "IISSiteStopped", "ExchangeDatabaseMounted", "SqlDatabaseCreated", "EntraConnectHealth"),
}


@dataclass(frozen=True)
class View:
    name: str
    log: str
    event_ids: tuple[int, ...]
    providers: tuple[str, ...]

    def column(self) -> Column:
        """Whether a canonical row belongs to the view; its ids reach the scan."""
        made = F.col("event_id").isin(list(self.event_ids)) & (F.upper("source_log") == self.log.upper())
        if self.providers:
            made = made & F.upper("provider").isin([p.upper() for p in self.providers])
        return F.coalesce(made & _condition(self.name), F.lit(False))


def _is(key: str, *values: str) -> Column:
    return F.upper(payload(key)).isin([v.upper() for v in values])


def _condition(name: str) -> Column:
    """What a view asks of the payload beyond its selectors."""
    of_class = {"ADComputerChangeDetailed": "computer", "ADUserChangeDetailed": "user", "ADGroupChangeDetailed": "group", "ADGroupPolicyChangesDetailed": "groupPolicyContainer", "GpoCreated": "groupPolicyContainer", "GpoDeleted": "groupPolicyContainer", "GpoModified": "groupPolicyContainer"}
    attribute = F.upper(F.coalesce(payload("AttributeLDAPDisplayName"), F.lit("")))
    if name in UNAVAILABLE:
        return F.lit(False)
    if name in of_class:
        return _is("ObjectClass", of_class[name])
    if name == "ADOrganizationalUnitChangeDetailed":
        return _is("ObjectClass", "organizationalUnit") & (attribute != "GPLINK")
    if name == "ADOtherChangeDetailed":
        return payload("ObjectClass").isNotNull() & ~_is("ObjectClass", "user", "computer", "organizationalUnit", "group")
    if name == "ADGroupPolicyChanges":
        return _is("ObjectClass", "groupPolicyContainer", "container")
    if name == "ADGroupPolicyEdits":
        return _is("ObjectClass", "groupPolicyContainer") & (attribute == "VERSIONNUMBER")
    if name == "ADGroupPolicyLinks":
        return _is("ObjectClass", "domainDNS", "organizationalUnit", "site") & (attribute == "GPLINK")
    if name == "GroupPolicyDirectoryAudit":
        return _is("ObjectClass", "groupPolicyContainer", "msWMI-Som") | attribute.isin("GPLINK", "GPOPTIONS", "GPCWQLFILTER")
    if name == "ADGroupChange":
        return ~F.coalesce(F.upper(payload("SubjectUserName")).contains("ANONYMOUS"), F.lit(False))
    if name == "ADUserLogonNTLMv1":
        return _is("LmPackageName", "NTLM V1")
    if name == "FileSystemError":
        return (F.col("event_id") == 55) | (payload("CorruptionActionState").try_cast("int") > 0)
    if name == "NetworkMonitorDriverLoaded":
        said = lambda c: F.when(c != "", c)
        return F.coalesce(said(payload("ServiceName")), said(payload("param1")), F.col("message")).rlike("(?i)npcap|npf|netmon")
    return F.lit(True)


VIEWS = {name: View(name, log, ids, providers) for name, log, ids, providers in LEAVES}


def add(view: View) -> None:
    """Registers a view of one's own beside the built-in ones."""
    if view.name in VIEWS or view.name in COMPOSITES:
        raise ValueError(f"there is a view {view.name!r}")
    VIEWS[view.name] = view


def expand(names: Sequence[str]) -> list[str]:
    """Leaf views of the names, each once, in order of first occurrence."""
    out: dict[str, None] = {}

    def walk(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"{name} contains itself")
        if name in VIEWS:
            out[name] = None
        else:
            for member in COMPOSITES[name]:
                walk(member, (*above, name))

    for n in names:
        walk(n, ())
    return list(out)


def sources(names: Sequence[str]) -> dict[str, tuple[set[int], set[str]]]:
    """For each log the event ids and providers that the views need."""
    out: dict[str, tuple[set[int], set[str]]] = {}
    for v in (VIEWS[n] for n in expand(names)):
        ids, providers = out.setdefault(v.log, (set(), set()))
        ids.update(v.event_ids)
        providers.update(v.providers)
    return out


def typed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the views, with type set to the first view, in order, that takes the row."""
    leaves = [VIEWS[n] for n in expand(names)]
    ids = sorted({i for v in leaves for i in v.event_ids})
    type_ = F.coalesce(*[F.when(v.column(), v.name) for v in leaves])
    return rows.where(F.col("event_id").isin(ids)).withColumn("type", type_).where(F.col("type").isNotNull())


#: The columns of views whose events carry them as they are: (column, kind, payload keys, the first that is there counts).
_VM = (("vm_name", "text", ("VmName", "Name")), ("user", "text", ("User", "UserName", "AccountName")))
_DEVICE = (("device_id", "text", ("DeviceId",)), ("device_name", "text", ("DeviceDescription", "DeviceName")), ("class_id", "text", ("ClassId",)), ("class_name", "text", ("ClassName",)))
_POLICY = (("policy_scope", "text", ("NoNameA0",)), ("item_name", "text", ("NoNameA1",)), ("policy_name", "text", ("NoNameA2", "ExtensionName")), ("error", "text", ("NoNameA3", "ErrorDescription")))
_DEGRADATION = (
    ("name", "text", ("Name",)), ("friendly_name", "text", ("FriendlyName",)), ("version", "text", ("Version",)), ("path", "text", ("Path",)),
    ("duration_ms", "long", ("TotalTime",)), ("degradation_ms", "long", ("DegradationTime",)), ("incident_time", "time", ("StartTime",)),
)
_START = (("start_time", "time", ("StartTime", "#text", "ActionDetailsDateTime")),)
OWN_COLUMNS = {
    "OSCrash": _START, "OSStartup": _START, "OSShutdown": _START, "OSUncleanShutdown": _START, "OSStartupSecurity": _START, "OSCrashOnAuditFailRecovery": _START,
    "OSTimeChange": (("previous_time", "text", ("PreviousTime",)), ("new_time", "text", ("NewTime",))),
    "OSBugCheck": (
        ("bug_check_code", "text", ("BugcheckCode", "param1")), ("parameter1", "text", ("BugcheckParameter1",)), ("parameter2", "text", ("BugcheckParameter2",)), ("parameter3", "text", ("BugcheckParameter3",)),
        ("parameter4", "text", ("BugcheckParameter4",)), ("dump_file", "text", ("DumpFile", "param2")), ("report_id", "text", ("ReportId", "param3")),
    ),
    "WindowsUpdateFailure": (("reason", "text", ("ErrorDescription", "Message", "ErrorCode", "ResultCode")),),
    "BitLockerKeyChange": (("master_key_id", "text", ("MasterKeyId",)), ("recovery_server", "text", ("RecoveryServer",))),
    "DeviceRecognized": (*_DEVICE, ("vendor_ids", "text", ("VendorIds",)), ("compatible_ids", "text", ("CompatibleIds",)), ("location", "text", ("LocationInformation",))),
    "DeviceDisabled": (*_DEVICE, ("reason", "text", ("Reason",))),
    "AuditPolicyChange": (("category_id", "text", ("CategoryId",)), ("subcategory_id", "text", ("SubcategoryId",)), ("subcategory_guid", "text", ("SubcategoryGuid",)), ("changes", "text", ("AuditPolicyChanges",))),
    "KerberosPolicyChange": (("policy_changes", "text", ("KerberosPolicyChange",)),),
    "ADLdapBindingDetails": (("remote_endpoint", "text", ("NoNameA0",)), ("account_name", "text", ("NoNameA1",)), ("bind_type", "text", ("NoNameA2",))),
    "LogsClearedSecurity": (("backup_path", "text", ("BackupPath",)),), "LogsClearedOther": (("backup_path", "text", ("BackupPath",)),), "ObjectDeletion": (("path", "text", ("ObjectName",)),),
    "DhcpLeaseCreated": (("ip_address", "text", ("IpAddress", "ClientIp")), ("mac_address", "text", ("HwAddress", "MacAddress"))),
    "NetworkAccessAuthenticationPolicy": (
        ("security_id", "text", ("SubjectUserSid",)), ("called_station_id", "text", ("CalledStationID",)), ("calling_station_id", "text", ("CallingStationID",)), ("nas_ipv4", "text", ("NASIPv4Address",)),
        ("nas_ipv6", "text", ("NASIPv6Address",)), ("nas_identifier", "text", ("NASIdentifier",)), ("nas_port", "text", ("NASPort",)), ("nas_port_type", "text", ("NASPortType",)),
        ("provider_used", "text", ("AuthenticationProvider",)), ("server_used", "text", ("AuthenticationServer",)), ("authentication_type", "text", ("AuthenticationType",)), ("eap_type", "text", ("EAPType",)),
        ("client_ip", "text", ("ClientIPAddress",)), ("client_name", "text", ("ClientName",)), ("request_policy", "text", ("ProxyPolicyName",)), ("network_policy", "text", ("NetworkPolicyName",)),
        ("reason", "text", ("Reason",)), ("reason_code", "text", ("ReasonCode",)),
    ),
    "ClientGroupPoliciesApplication": _POLICY, "ClientGroupPoliciesSystem": _POLICY,
    "HyperVVirtualMachineShutdown": _VM, "HyperVVirtualMachineStarted": _VM, "HyperVCheckpointCreated": (*_VM, ("checkpoint_name", "text", ("CheckpointName", "SnapshotName", "FriendlyName"))),
    "ExchangeDatabaseMounted": (("database", "text", ("Database", "Mailbox Database")),), "SqlDatabaseCreated": (("database", "text", ("Database", "Database Name")),),
    "AADConnectRunProfile": (("connector", "text", ("Connector", "Connector Name")), ("run_profile", "text", ("RunProfileName", "Run Profile Name"))),
    "AADConnectStagingDisabled": (("operator", "text", ("Operator",)),), "AADConnectStagingEnabled": (("operator", "text", ("Operator",)),), "NetworkPromiscuousMode": (("adapter", "text", ("AdapterName", "Name")),),
    "DiskError": (("device_name", "text", ("DeviceName", "NoNameA0")), ("block_address", "text", ("Lba", "NoNameA1")), ("disk_number", "long", ("DiskNumber", "NoNameA2"))),
    "FileSystemError": (("volume_name", "text", ("DriveName", "NoNameA1")), ("device_name", "text", ("DeviceName", "NoNameA0")), ("corruption_state", "long", ("CorruptionActionState",)), ("description", "text", ("Description",)), ("outcome", "text", ("Outcome",))),
    "StorageReset": (("device_name", "text", ("DeviceName", "NoNameA0")),), "DisplayDriverReset": (("driver_name", "text", ("DriverName", "NoNameA0")),),
    "HardwareError": (("error_source", "text", ("ErrorSource",)), ("error_type", "text", ("ErrorType",)), ("processor", "text", ("ApicId",)), ("device_name", "text", ("PrimaryDeviceName",)), ("physical_address", "text", ("PhysicalAddress",))),
    "ApplicationCrash": (
        ("application", "text", ("AppName", "NoNameA0")), ("application_version", "text", ("AppVersion", "NoNameA1")), ("module", "text", ("ModuleName", "NoNameA3")), ("module_version", "text", ("ModuleVersion", "NoNameA4")),
        ("exception_code", "text", ("ExceptionCode", "NoNameA6")), ("fault_offset", "text", ("FaultingOffset", "NoNameA7")), ("application_path", "text", ("AppPath", "NoNameA10")), ("module_path", "text", ("ModulePath", "NoNameA11")),
        ("report_id", "text", ("IntegratorReportId", "NoNameA12")),
    ),
    "ApplicationHang": (
        ("application", "text", ("AppName", "NoNameA0")), ("application_version", "text", ("AppVersion", "NoNameA1")), ("application_path", "text", ("ExeFileName", "NoNameA5")), ("hang_type", "text", ("HangType", "NoNameA9")),
        ("report_id", "text", ("ReportId", "NoNameA6")),
    ),
    "BootPerformance": (("duration_ms", "long", ("BootTime",)), ("main_path_ms", "long", ("MainPathBootTime",)), ("post_boot_ms", "long", ("BootPostBootTime",)), ("is_degradation", "truth", ("BootIsDegradation",)), ("incident_time", "time", ("BootStartTime",))),
    "ShutdownPerformance": (("duration_ms", "long", ("ShutdownTime",)), ("services_ms", "long", ("ShutdownServicesTime",)), ("is_degradation", "truth", ("ShutdownIsDegradation",)), ("incident_time", "time", ("ShutdownStartTime",))),
    "StartupDegradation": _DEGRADATION, "ShutdownDegradation": _DEGRADATION,
}


def own_columns(name: str) -> dict[str, Column]:
    """The columns of ``OWN_COLUMNS``; an empty payload text counts as none."""
    cast = {"text": lambda c: c, "long": lambda c: c.try_cast("long"), "truth": lambda c: c.try_cast("boolean"), "time": lambda c: F.try_to_timestamp(c)}
    return {column: cast[kind](F.coalesce(*[F.nullif(payload(k), F.lit("")) for k in keys])) for column, kind, keys in OWN_COLUMNS.get(name, ())}


def _fields(name: str) -> dict[str, Column]:
    """The columns that a view has of its own, by what its events carry."""
    v, code = payload, lambda key: decode.integer(payload(key))
    ids = set(VIEWS[name].event_ids)
    moved = F.col("event_id") == 5139
    if name == "ADGroupPolicyLinks":
        links = decode.policy_links(v("AttributeValue"))
        return {"operation": decode.operation(v("OperationType")), "domain_name": v("DSName"), "linked_to_type": v("ObjectClass"), "linked_to": v("ObjectDN"), "links": links}
    if ids & {5136, 5137, 5139, 5141}:
        return {
            "object_class": v("ObjectClass"), "object_guid": decode.guid(v("ObjectGUID")), "operation": F.coalesce(decode.operation(v("OperationType")), v("OperationType")),
            "object": F.when(moved, F.coalesce(v("OldObjectDN"), v("ObjectDN"))).otherwise(v("ObjectDN")), "field_changed": v("AttributeLDAPDisplayName"),
            "field_value": F.when(moved, F.coalesce(v("NewObjectDN"), v("AttributeValue"))).otherwise(v("AttributeValue")), "operation_correlation": v("OpCorrelationID"),
        }
    if ids & {4768, 4769, 4770, 4771, 4772}:
        return {
            "service": v("ServiceName"), "ip_address": text.normalize_ip(v("IpAddress")), "ip_port": v("IpPort").try_cast("int"), "ticket_options": decode.flags(code("TicketOptions"), decode.TICKET_OPTIONS), "status": v("Status"),
            "encryption_type": decode.name_of(code("TicketEncryptionType"), decode.ENCRYPTION_TYPES), "session_key_encryption_type": decode.name_of(code("SessionKeyEncryptionType"), decode.ENCRYPTION_TYPES),
            "pre_auth_type": decode.name_of(code("PreAuthType"), decode.PRE_AUTH_TYPES), "account_supports_aes": decode.supports_aes(code("AccountSupportedEncryptionTypes")), "account_supports_rc4": decode.supports_rc4(code("AccountSupportedEncryptionTypes")),
            "weak_encryption": decode.weak_encryption(code("TicketEncryptionType")), "weak_session_key_encryption": decode.weak_encryption(code("SessionKeyEncryptionType")),
        }
    if ids & {4624, 4625}:
        return {
            "logon_type": decode.name_of(code("LogonType"), decode.LOGON_TYPES), "logon_id": v("TargetLogonId"), "ip_address": text.normalize_ip(v("IpAddress")), "ip_port": v("IpPort").try_cast("int"), "workstation": v("WorkstationName"),
            "process": v("ProcessName"), "package": v("AuthenticationPackageName"), "lm_package": v("LmPackageName"), "status": decode.name_of(code("Status"), decode.STATUS_CODES), "sub_status": decode.name_of(code("SubStatus"), decode.STATUS_CODES),
        }
    if name == "ADLdapBindingSummary":
        return {"simple_binds_without_tls": v("NoNameA0").try_cast("int"), "negotiate_binds_without_signing": v("NoNameA1").try_cast("int")}
    if name.startswith("ADUser") or name.startswith("ADComputer"):
        return {"sam_account": v("SamAccountName"), "display_name": v("DisplayName"), "old_flags": decode.flags(code("OldUacValue")), "new_flags": decode.flags(code("NewUacValue")), "privileges": text.distinct_values(v("PrivilegeList"))}
    if name.startswith("ADGroup"):
        return {"member": v("MemberName"), "member_sid": v("MemberSid"), "sam_account": v("SamAccountName"), "group_type": v("GroupTypeChange")}
    if name.startswith("ScheduledTask"):
        return {"task_name": v("TaskName"), "task_content": F.coalesce(v("TaskContentNew"), v("TaskContent"))}
    if name.startswith("Firewall"):
        return {"rule_id": v("RuleId"), "rule_name": v("RuleName"), "profile": v("ProfileChanged")}
    if name.startswith("Defender"):
        return {"threat": v("Threat Name"), "severity": v("Severity Name"), "category": v("Category Name"), "path": v("Path"), "action_taken": v("Action Name"), "old_value": v("Old Value"), "new_value": v("New Value")}
    if name == "ServiceFailure":
        id_ = F.col("event_id")
        of = lambda ids, key: F.when(id_.isin(*ids), v(key))
        return {
            "service_name": F.when(id_ == 7009, v("param2")).otherwise(v("param1")), "error": of((7000, 7023), "param2"), "failure_count": of((7031, 7034), "param2").try_cast("long"),
            "timeout_ms": of((7009,), "param1").try_cast("long"), "recovery_delay_ms": of((7031,), "param3").try_cast("long"), "recovery_action": of((7031,), "param5"),
        }
    if name == "SyncCompleted":
        return {"counts": F.map_from_arrays(F.regexp_extract_all("message", F.lit(r"(\w+):\s*\d+"), F.lit(1)), F.transform(F.regexp_extract_all("message", F.lit(r"\w+:\s*(\d+)"), F.lit(1)), lambda x: x.try_cast("long")))}
    if name == "IISSiteBindingFailure":
        return {"binding": F.nullif(F.regexp_extract("message", r"(?i)URL prefix\s+(\S+)", 1), F.lit("")), "site": F.nullif(F.regexp_extract("message", r"site\s+['\"]?([^'\"]+)", 1), F.lit(""))}
    return own_columns(name)


def projected(rows: DataFrame, name: str) -> DataFrame:
    """A leaf view with its columns: computer, action, who, account, time, record_id, those of its own, and the payload as details."""
    own = {k: c.alias(k) for k, c in _fields(name).items()}
    shared = {
        "computer": F.col("source_computer"), "action": text.message_subject(F.col("message")), "who": text.compose_account(payload("SubjectDomainName"), payload("SubjectUserName")),
        "account": text.compose_account(payload("TargetDomainName"), payload("TargetUserName")), "time": F.col("time_created"),
    }
    return typed(rows, [name]).select("record_id", *[c.alias(k) for k, c in shared.items()], *own.values(), F.col("values").alias("details"))


#: What presets ask of payloads beyond their own keys, by the types that have it.
_DERIVED = (
    (("KerberosTGTRequest", "KerberosServiceTicket"), "WeakEncryptionAlgorithm", lambda: decode.weak_encryption(decode.integer(payload("TicketEncryptionType"))).cast("string")),
    (("KerberosTGTRequest", "KerberosServiceTicket"), "WeakSessionKeyEncryptionAlgorithm", lambda: decode.weak_encryption(decode.integer(payload("SessionKeyEncryptionType"))).cast("string")),
    (("ADLdapBindingSummary",), "SimpleBindsWithoutTls", lambda: payload("NoNameA0")),
    (("ADLdapBindingSummary",), "NegotiateBindsWithoutSigning", lambda: payload("NoNameA1")),
)


def derived(rows: DataFrame) -> DataFrame:
    """``rows`` with the derived payload entries of their types; entries of the same name are replaced."""
    made = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col("type").isin(*types), F.struct(F.lit(k).alias("key"), c().alias("value"))) for types, k, c in _DERIVED])))
    own = F.map_filter(F.coalesce("values", F.create_map().cast("map<string,string>")), lambda k, _: ~F.exists(F.map_keys(made), lambda m: F.lower(m) == F.lower(k)))
    return rows.withColumn("values", F.map_concat(own, made))


def preset(rows: DataFrame, name: str) -> DataFrame:
    """The rows that a monitoring preset asks for."""
    names, condition = PRESETS[name]
    found = derived(typed(rows, names))
    return found if condition is None else found.where(compile_predicate(condition, found))


def register(rows: DataFrame) -> None:
    """A temporary SQL view for each leaf and composite."""
    for name in (*VIEWS, *COMPOSITES):
        typed(rows, [name]).createOrReplaceTempView(name)


def _type(*names: str) -> Predicate:
    return compare("type", "In", *names) if len(names) > 1 else compare("type", "Equal", names[0])


#: Monitoring presets: the views to read and the condition on them.
PRESETS: dict[str, tuple[tuple[str, ...], Predicate | None]] = {
    "AuthenticationHealth": (("AuthenticationHealth",), any_of(
        _type("ADUserLogonNTLMv1"),
        all_of(_type("KerberosTGTRequest", "KerberosServiceTicket"), any_of(compare("WeakEncryptionAlgorithm", "Equal", True), compare("WeakSessionKeyEncryptionAlgorithm", "Equal", True))),
        _type("KerberosKdcRc4Audit"),
        _type("ADLdapBindingDetails"),
        all_of(_type("ADLdapBindingSummary"), any_of(compare("SimpleBindsWithoutTls", "GreaterThan", 0), compare("NegotiateBindsWithoutSigning", "GreaterThan", 0))),
    )),
    "ScheduledTaskActivity": (("ScheduledTaskActivity",), None),
    "FirewallRuleActivity": (("FirewallRuleActivity",), None),
    "DefenderSecurity": (("DefenderSecurity",), None),
}


@dataclass(frozen=True)
class DefinedField:
    """origin: Data, Metadata, MessageData, Message or Constant; kind: a Spark type name."""

    name: str
    origin: str
    source: str = ""
    kind: str = "string"
    default: str | None = None


def defined(rows: DataFrame, log: str, event_ids: Sequence[int], fields: Sequence[DefinedField]) -> DataFrame:
    """A user-defined view. A value that cannot be read as its kind fails the query."""
    names = [f.name.lower() for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("field names must differ")
    made = []
    for f in fields:
        value = {
            "Data": lambda f: payload(f.source), "Metadata": lambda f: F.col(f.source).cast("string"), "Message": lambda f: F.col("message"), "Constant": lambda f: F.lit(f.source),
            "MessageData": lambda f: F.element_at(text.key_value_lines(F.col("message")), f.source),
        }[f.origin](f)
        made.append(F.coalesce(value, F.lit(f.default)).cast(f.kind).alias(f.name))
    take = [F.upper("source_log") == log.upper(), F.col("event_id").isin(list(event_ids))]
    return rows.where(reduce(lambda a, b: a & b, take)).select("time_created", "record_id", "source_computer", *made)
