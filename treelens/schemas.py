"""Row types of the tables that operators exchange."""

LISTING = "project_id string, abs_path string, path string, is_dir boolean, size bigint, mtime timestamp, ctime timestamp"
FILES = "project_id string, seq bigint, path string, name string, parent string, depth int, extension string, size bigint, modified_time timestamp, created_time timestamp, is_hidden boolean"
IMPORT = "struct<module:string,name:string,alias:string,relative_level:int>"
METHOD = "struct<name:string,line:int,end_line:int,async_method:boolean,decorators:array<string>,docstring:string>"
CLASS = f"struct<name:string,line:int,end_line:int,decorators:array<string>,base_classes:array<string>,docstring:string,methods:array<{METHOD}>>"
FUNCTION = "struct<name:string,line:int,end_line:int,decorators:array<string>,async_function:boolean,docstring:string>"
VARIABLE = "struct<name:string,line:int>"
SYMBOLS = f"imports array<{IMPORT}>, classes array<{CLASS}>, functions array<{FUNCTION}>, variables array<{VARIABLE}>, deps array<string>, diagnostic string"
