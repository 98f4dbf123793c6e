"""Queries in the SELECT dialect over the folder's tables, each beside the SQL it is checked against."""

from __future__ import annotations

from typing import Any

# name -> (dialect text, parameters, SQL of the check; None: the dialect text itself)
CASES: dict[str, tuple[str, Any, str | None]] = {
    "prj_select_all": ("select * from region", None, None),
    "prj_columns_reordered": ("select c_mktsegment, c_custkey from customer", None, None),
    "prj_alias": ("select c_custkey as id, c_name nm from customer", None, "select c_custkey as id, c_name as nm from customer"),
    "prj_repeat_column": ("select c_custkey, c_custkey as k2 from customer", None, None),
    "prj_name_as_typed": ("select C_CUSTKEY from customer", None, 'select c_custkey as "C_CUSTKEY" from customer'),
    "prj_delimited_names": ('select [p_partkey], "p_name" from [part]', None, "select p_partkey, p_name from part"),
    "flt_eq_string": ("select o_orderkey from orders where o_orderstatus = 'F'", None, None),
    "flt_eq_string_padded": ("select o_orderkey from orders where o_orderpriority = '5-LOW   '", None, "select o_orderkey from orders where rtrim(o_orderpriority, ' ') = '5-LOW'"),
    "flt_eq_case_sensitive": ("select o_orderkey from orders where o_orderstatus = 'f'", None, None),
    "flt_ne": ("select p_partkey from part where p_type <> 'ECONOMY'", None, None),
    "flt_ne_bang": ("select p_partkey from part where p_size != 10", None, None),
    "flt_lt": ("select l_orderkey, l_linenumber from lineitem where l_quantity < 5", None, None),
    "flt_le": ("select l_orderkey, l_linenumber from lineitem where l_quantity <= 5", None, None),
    "flt_gt": ("select o_orderkey from orders where o_totalprice > 450000.5", None, None),
    "flt_ge": ("select l_orderkey from lineitem where l_discount >= 0.05", None, "select l_orderkey from lineitem where l_discount >= cast(0.05 as double)"),
    "flt_negative_literal": ("select c_custkey from customer where c_acctbal < -500", None, None),
    "flt_flipped_operands": ("select p_partkey from part where 25 <= p_size", None, None),
    "flt_column_vs_column": ("select l_orderkey, l_linenumber from lineitem where l_discount > l_tax", None, None),
    "flt_string_range": ("select p_partkey from part where p_type >= 'M' and p_type < 'Q'", None, None),
    "flt_between": ("select o_orderkey from orders where o_totalprice between 1000 and 50000", None, None),
    "flt_not_between": ("select p_partkey from part where p_size not between 5 and 45", None, None),
    "flt_between_null_high": ("select p_partkey from part where p_size not between 10 and null", None, None),
    "flt_in": ("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')", None, None),
    "flt_not_in": ("select p_partkey from part where p_size not in (1, 2, 3)", None, None),
    "flt_in_with_null": ("select p_partkey from part where p_size in (1, null)", None, None),
    "flt_not_in_with_null": ("select p_partkey from part where p_size not in (1, null)", None, None),
    "flt_like_prefix": ("select p_partkey, p_name from part where p_name like 'blue%'", None, None),
    "flt_like_suffix": ("select p_partkey from part where p_name like '%widget'", None, None),
    "flt_like_contains": ("select p_partkey from part where p_name like '%an%'", None, None),
    "flt_like_underscore": ("select r_regionkey from region where r_name like '_SIA'", None, None),
    "flt_not_like": ("select p_partkey from part where p_type not like 'S%'", None, None),
    "flt_like_multiline": ("select doc_id from documents where text like '%e%e%'", None, "select doc_id from documents where rtrim(text, ' ') like '%e%e%'"),
    "flt_is_null": ("select rec_no from client where address is null", None, None),
    "flt_is_not_null": ("select rec_no from client where clien_hist is not null", None, None),
    "flt_eq_null": ("select o_orderkey from orders where not (o_orderstatus = null)", None, None),
    "flt_null_column_three_valued": ("select rec_no from client where not (city = 'Ruldumont') or state = 'FL'", None, "select rec_no from client where not (rtrim(city, ' ') = 'Ruldumont') or rtrim(state, ' ') = 'FL'"),
    "flt_and_or_precedence": ("select o_orderkey from orders where o_orderstatus = 'P' or o_orderstatus = 'F' and o_totalprice > 400000", None, None),
    "flt_parens_not": ("select o_orderkey from orders where not (o_orderstatus = 'P' or o_totalprice > 100000)", None, None),
    "flt_boolean_literal": ("select n_nationkey from nation where true = true and n_regionkey = 2", None, None),
    "flt_boolean_column": ("select rec_no from dbase_31 where discontinu = true", None, None),
    "flt_decimal_column": ("select rec_no from dbase_31 where unitprice > 99.5", None, None),
    "flt_date_ge": ("select o_orderkey from orders where o_orderdate >= '2001-01-01'", None, "select o_orderkey from orders where o_orderdate >= timestamp '2001-01-01 00:00:00'"),
    "flt_date_between": ("select o_orderkey from orders where o_orderdate between '1996-01-01' and '1996-12-31'", None, "select o_orderkey from orders where o_orderdate between timestamp '1996-01-01 00:00:00' and timestamp '1996-12-31 00:00:00'"),
    "flt_datetime_t": ("select event_id from events where ts < '2024-01-02T06:30:00'", None, "select event_id from events where ts < timestamp '2024-01-02 06:30:00'"),
    "flt_date_column_vs_moment": ("select rec_no from dbase_03 where date_visit < '2003-06-15 00:00:01'", None, "select rec_no from dbase_03 where cast(date_visit as timestamp) < timestamp '2003-06-15 00:00:01'"),
    "par_named": ("select o_orderkey from orders where o_custkey = @cust", {"cust": 42}, "select o_orderkey from orders where o_custkey = 42"),
    "par_positional": ("select o_orderkey from orders where o_totalprice >= ? and o_orderstatus = ?", [400000, "O"], "select o_orderkey from orders where o_totalprice >= 400000 and o_orderstatus = 'O'"),
    "srt_top_asc": ("select top 20 c_custkey, c_acctbal from customer order by c_acctbal, c_custkey", None, "select c_custkey, c_acctbal from customer order by c_acctbal asc nulls first, c_custkey limit 20"),
    "srt_limit_desc": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20", None, "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 20"),
    "srt_multi_key": ("select top 50 o_orderkey from orders order by o_orderpriority desc, o_totalprice, o_orderkey", None, "select o_orderkey from orders order by o_orderpriority desc nulls last, o_totalprice nulls first, o_orderkey limit 50"),
    "srt_nulls_first": ("select top 30 rec_no from dbase_31 order by unitprice, rec_no", None, "select rec_no from dbase_31 order by unitprice asc nulls first, rec_no limit 30"),
    "srt_nulls_last_desc": ("select top 30 rec_no, city from client order by city desc, rec_no", None, "select rec_no, city from client order by rtrim(city, ' ') desc nulls last, rec_no limit 30"),
    "srt_alias": ("select top 10 p_partkey as id, p_retailprice as price from part order by price desc, id", None, "select p_partkey as id, p_retailprice as price from part order by price desc, id limit 10"),
    "srt_unprojected": ("select top 10 s_name from supplier order by s_acctbal, s_suppkey", None, "select s_name from supplier order by s_acctbal, s_suppkey limit 10"),
    "srt_full": ("select rec_no, comments from dbase_03 order by comments desc, rec_no", None, "select rec_no, comments from dbase_03 order by rtrim(comments, ' ') desc nulls last, rec_no"),
    "topk_filtered": ("select top 10 o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 300000 order by o_totalprice desc, o_orderkey", None, "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 300000 order by o_totalprice desc, o_orderkey limit 10"),
    "lim_zero": ("select top 0 n_name from nation", None, "select n_name from nation limit 0"),
    "lim_exceeds_rows": ("select top 100 r_name from region", None, "select r_name from region"),
    "lim_file_order": ("select top 7 c_custkey from customer", None, "select c_custkey from customer order by file_row_number limit 7"),
    "agg_count_all": ("select count(*) from lineitem", None, 'select cast(count(*) as integer) as "count" from lineitem'),
    "agg_count_where": ("select count(*) from lineitem where l_quantity between 10 and 20 and l_returnflag = 'R'", None, "select cast(count(*) as integer) as \"count\" from lineitem where l_quantity between 10 and 20 and l_returnflag = 'R'"),
    "agg_count_top_one": ("select top 5 count(*) from orders", None, 'select cast(count(*) as integer) as "count" from orders'),
    "agg_count_top_zero": ("select top 0 count(*) from orders", None, 'select cast(count(*) as integer) as "count" from orders limit 0'),
}
#: File order can't be told by views of the check.
NO_ORACLE = ("lim_file_order",)
