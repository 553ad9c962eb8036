"""The flat event: 77 ordered columns, with strings empty where missing."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "normalized_v3"

# The columns of a flat event in order, and of the audit the role and the object types each applies to.
PROVENANCE = "file_id archive_name member_name line_number raw_event_id parse_status parse_error".split()
CORE = "timestamp_raw timestamp_parsed host_raw action_raw object_raw".split()
CONTROL = ["source_type"]
DERIVED = "user_raw process_raw parent_process_raw destination_raw object_value_raw".split()
IDS = "actor_id_raw object_id_raw pid_raw ppid_raw tid_raw principal_raw".split()
DISCOVERY = ["properties_keys_raw", "unmapped_property_keys_raw"]

# Columns taken from nested properties: key and the object types that have it.
PROPERTIES = {
    "image_path_raw": ("image_path", "PROCESS FLOW FILE MODULE THREAD SHELL"),
    "parent_image_path_raw": ("parent_image_path", "PROCESS"),
    "command_line_raw": ("command_line", "PROCESS"),
    "file_path_raw": ("file_path", "FILE"),
    "module_path_raw": ("module_path", "MODULE"),
    "registry_key_raw": ("key", "REGISTRY"),
    "registry_value_raw": ("value", "REGISTRY"),
    "registry_data_raw": ("data", "REGISTRY"),
    "registry_type_raw": ("type", "REGISTRY"),
    "generic_path_raw": ("path", "TASK"),
    "info_class_raw": ("info_class", "FILE THREAD"),
    "task_name_raw": ("task_name", "TASK"),
    "task_pid_raw": ("task_pid", "TASK"),
    "task_process_uuid_raw": ("task_process_uuid", "TASK"),
    "property_name_raw": ("name", "SERVICE"),
    "service_name_raw": ("name", "SERVICE"),
    "service_type_raw": ("service_type", "SERVICE"),
    "service_start_type_raw": ("start_type", "SERVICE"),
    "src_ip_raw": ("src_ip", "FLOW"),
    "src_port_raw": ("src_port", "FLOW"),
    "dest_ip_raw": ("dest_ip", "FLOW"),
    "dest_port_raw": ("dest_port", "FLOW"),
    "direction_raw": ("direction", "FLOW"),
    "protocol_raw": ("l4protocol", "FLOW"),
    "shell_payload_raw": ("payload", "SHELL"),
    "shell_context_raw": ("context_info", "SHELL"),
    "logon_id_raw": ("logon_id", "USER_SESSION"),
    "property_user_raw": ("user", "USER_SESSION"),
    "privileges_raw": ("privileges", "USER_SESSION"),
    "acuity_level_raw": ("acuity_level", ""),
    "thread_src_pid_raw": ("src_pid", "THREAD"),
    "thread_src_tid_raw": ("src_tid", "THREAD"),
    "thread_tgt_pid_raw": ("tgt_pid", "THREAD"),
    "thread_tgt_tid_raw": ("tgt_tid", "THREAD"),
    "property_size_raw": ("size", "FILE FLOW"),
    "base_address_raw": ("base_address", "MODULE"),
    "stack_base_raw": ("stack_base", "THREAD"),
    "subprocess_tag_raw": ("subprocess_tag", "THREAD"),
    "stack_limit_raw": ("stack_limit", "THREAD"),
    "start_address_raw": ("start_address", "THREAD"),
    "user_stack_base_raw": ("user_stack_base", "THREAD"),
    "user_stack_limit_raw": ("user_stack_limit", "THREAD"),
    "flow_end_time_raw": ("end_time", "FLOW"),
    "flow_start_time_raw": ("start_time", "FLOW"),
    "new_path_raw": ("new_path", "FILE"),
    "process_sid_raw": ("sid", "PROCESS"),
    "thread_tgt_pid_uuid_raw": ("tgt_pid_uuid", "THREAD"),
    "requesting_logon_id_raw": ("requesting_logon_id", "USER_SESSION"),
    "requesting_domain_raw": ("requesting_domain", "USER_SESSION"),
    "requesting_user_raw": ("requesting_user", "USER_SESSION"),
    "task_user_name_raw": ("user_name", "TASK"),
}
APPLIES = {c: v.split() for c, (_, v) in PROPERTIES.items()} | {
    "process_raw": "PROCESS FLOW FILE MODULE THREAD SHELL".split(), "parent_process_raw": ["PROCESS"], "destination_raw": ["FLOW"],
}
COLUMNS = [*PROVENANCE, *CORE, *CONTROL, *DERIVED, *IDS, *PROPERTIES, *DISCOVERY]
MAPPED_KEYS = sorted({k for k, _ in PROPERTIES.values()})
EVENT_SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in ("file_id", "line_number") else T.StringType()) for c in COLUMNS])

#: Sort order of evidence: the time, then where the event stands.
LOCATOR = ["event_time", "archive_name", "member_name", "line_number", "raw_event_id"]


def role_of(column: str) -> str:
    if column in PROVENANCE:
        return "provenance"
    if column in CORE:
        return "core"
    if column in CONTROL:
        return "control"
    if column in DISCOVERY:
        return "discovery"
    return "object_specific" if column in APPLIES else "entity"
