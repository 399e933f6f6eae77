"""Row types: one row for each fact."""

from __future__ import annotations

DOCUMENT = "page_id long, url string, base string, lang string, mime_type string, content string, generated_content string"
LINK = (
    "struct<pos:int,link_type:string,href:string,abs_url:string,alt:string,has_alt:boolean,title:string,anchor:string,line_no:int,column_no:int,lang:string,content_section:string,landmark:string,landmark_marker:string,"
    "in_anchor:boolean,in_list:boolean,list_heading:string,has_img:boolean,noscript:boolean,modified_content:boolean,generated_content:boolean,on_page_id_reference:boolean,attr:map<string,string>>"
)
ELEMENT = "struct<pos:int,tag:string,line_no:int,column_no:int,landmark:string,section:string,attr:map<string,string>>"
SPAN = "struct<lang:string,text:string>"
#: Uses of a feature in a section of a page, and the place of the first.
FEATURE = "struct<section:string,feature:string,n:bigint,line_no:int,column_no:int>"
#: Everything that one parse of a page yields; features and tags are counted only where they are asked for.
FACTS = (
    f"links array<{LINK}>, anchors string, elements array<{ELEMENT}>, paragraphs string, texts array<{SPAN}>, scripts string, styles array<string>, "
    f"features array<{FEATURE}>, tags array<struct<tag:string,n:bigint>>, "
    "html_lang string, title string, metadata array<struct<name:string,content:string,line_no:int,column_no:int>>, headings array<struct<level:int,text:string,lang:string,line_no:int>>"
)
#: The uniform output of every check. -1 stands for a place that doesn't apply.
RESULT = (
    "testcase string, status int, description string, line_no int, column_no int, page_no int, source_line string, message string, url string, help_url string, impact string, "
    "landmark string, landmark_marker string, tags string, testcase_groups string, xpath string"
)
