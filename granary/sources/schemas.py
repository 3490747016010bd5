"""Record shapes as DDL; readers take them as they are."""

from __future__ import annotations


def with_corrupt(schema: str) -> str:
    return f"{schema}, _corrupt_record string"


INSTANCE = (
    "id string, bug_id string, focal_method string, focal_method_name string, test_case string, test_prefix string, assertion string, processed_assertion string, "
    "expected_value string, actual_value string, test_class_fields array<string>, focal_class_fields array<string>, focal_class_methods array<string>, invocations array<string>"
)
_FOCAL = "struct<name:string,path:string,superclass:string,interface:string,imports:array<string>,fields:array<string>,methods:array<string>,other_methods:array<string>,fields_dict:map<string,string>,text:string>"
_TEST = "struct<path:string,imports:array<string>,fields:array<string>,methods:array<string>,text:string>"
TRIGGERING = (
    "bug_id string, version string, focal_method_signature string, test_case_signature string, test_file string, source_file string, focal_method string, return_type string, "
    f"test_case string, parent_test_case string, test_case_invocations array<string>, test_class {_TEST}, focal_class {_FOCAL}"
)
CANDIDATE = (f"bug_id string, version string, focal_method_signature string, source_file string, focal_method string, return_type string, assertion_subject_candidates array<string>, focal_class {_FOCAL}")
RECORD_FILE = (
    "focal_method struct<identifier:string,body:string>, test_case struct<body:string,invocations:array<string>>, test_class struct<fields:array<struct<original_string:string>>>, "
    "focal_class struct<fields:array<struct<original_string:string>>,methods:array<struct<full_signature:string>>>"
)
TEST_CORPUS = ("bug_id string, uts map<string,string>")
RETRIEVED = ("tgt string, found array<struct<id:string,key:string,sim:double>>")
EMBEDDING = ("key string, embedding array<float>")
MESSAGE = "struct<role:string,content:string>"
HISTORY = f"array<{MESSAGE}>"
FIRST_ROUND = (f"member string, id string, focal_method string, test_case string, test_prefix string, retrieved_focal_method string, retrieved_test_case string, expected_value string, history {HISTORY}")
CONSENSUS = (f"id string, record struct<focal_method:string,test_case:string,expected_value:string,processed_assertion:string,response:string,complete_responses:map<string,{HISTORY}>>")
SCORED = ("member string, id long, focal_method string, expected_value string, response string, prob double")
BUG_DETECTION = ("project_id string, version_id string, test_suite_source string, test_id int, test_classification string, num_trigger int")
COVERAGE_CSV = ("TARGET_CLASS string, criterion string, Coverage double, Total_Goals int, Covered_Goals int")
COVERAGE = ("_name string, class array<struct<_name:string,method:array<struct<_name:string,_desc:string>>>>")
SIGNATURE = ("idx long, bug_id string, bytecode_signature string")
