"""Logical schemas of the fact tables. Never inferred."""

from pyspark.sql import types as T

DDL = {
    "packages": "generation string, import_path string, pkg_path string, name string, dir string, standard boolean, for_test string, module struct<path:string,version:string,dir:string,main:boolean>, replace_dir string, go_files array<string>, cgo_files array<string>, c_files array<string>, s_files array<string>, syso_files array<string>, embed_files array<string>, other_files array<string>, error string",
    "imports": "generation string, import_path string, imported string, import_ord int",
    "package_files": "generation string, dir string, file string, kind string, content binary",
    "subjects": "package string, symbol string, declaration string, open_world boolean, ambiguous string",
    "directives": "package string, symbol string, directive string",
    "declarations": "generation string, package string, file string, kind string, name string, receiver string, pkg_clause string, group_id bigint, ord int, content binary, hash string, refs array<string>",
    "file_headers": "generation string, package string, file string, hash string, embedded boolean",
    "functions": "fn string, pkg string, sig string, std boolean, parent string",
    "static_edges": "caller string, site string, callee string",
    "address_taken": "fn string, by_fn string",
    "dyn_sites": "site string, fn string, sig string",
    "invoke_sites": "site string, fn string, iface string, method string",
    "make_iface": "fn string, type string",
    "type_methods": "type string, method string, impl_fn string, exported boolean",
    "type_components": "type string, component string",
    "iface_methods": "iface string, method string",
    "roots": "subject string, fn string, kind string",
    "effects": "fn string, pkg string, tier string, kind int, package_path string, symbol string, detail string, reason string, unrefinable boolean, observable boolean",
    "env_snapshot": "generation string, key string, value string, present boolean",
    "machine_facts": "generation string, cpu_model string, physical_cores int, logical_cores int, total_ram_bytes bigint, os string, kernel_version string",
    "testlog": "process string, seq bigint, line binary",
    "path_state": "phase string, path string, resolved string, links array<string>, kind string, exists boolean, size bigint, mode bigint, mtime_ns bigint, content_sha string",
    "manifest_entries": "manifest_id string, kind string, ident string, digest string",
    "bracket_roots": "bracket string, kind string, path string, digest string",
    "bracket_members": "bracket string, root string, member string",
    "recordings": "subject struct<package:string,symbol:string>, maximal_closure string, test_variant_closure string, observation_assertion string, proof struct<strategy:string,subject:struct<package:string,symbol:string>,observable:boolean,reason:string,evidence:string>, guards struct<toolchain:string,build_config:string,machine:string,runtime_config:string>, purity_assertion string, vouches array<string>, single_subject array<string>, package_process array<string>, dynamic_state_strategy string, runtime_inputs string, runtime_digest string, result_kind int",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(DDL[name])
