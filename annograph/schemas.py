"""Table schemas, issue codes and the fixed values that annotation documents must carry."""

from __future__ import annotations

# --- Fixed values. They appear literally in documents and reports, so they are stated as they are. ---
SCHEMA_VERSION = "1.2"
IMAGE_SUFFIXES = (".bmp", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
TRAINING_SUFFIX_ORDER = (".bmp", ".png", ".jpg", ".jpeg", ".tif", ".tiff")
RESOLVE_SUFFIX_ORDER = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
POINT_LABELS = ("sew", "keypoint")
STRICT_POINT_LABEL = "sew"
DEFAULT_SIDE = 256
DEFAULT_SPACING = 28.0

ISSUE_TEXT = {
    "POINT_NOT_OBJECT": "point[%d] 不是对象，已跳过",
    "POINT_INVALID": "point[%d] 缺少有效的 id/x/y，已跳过",
    "POINT_ID_DUP": "point id %d 重复，已重排",
    "EDGE_NOT_OBJECT": "edge[%d] 不是对象，已跳过",
    "EDGE_INVALID": "edge[%d] 缺少有效的 src/dst，已跳过",
    "EDGE_DANGLING": "edge[%d] 引用了不存在的点 %d/%d，已跳过",
    "EDGE_SELF_LOOP": "edge[%d] 是自环，已跳过",
    "EDGE_DUP": "edge[%d] 与已有边重复，已去重",
    "IMAGE_PATH_BACKFILLED": "image_path 缺失，已回填为 sample_id.png",
    "NOT_AN_OBJECT": "标注内容不是有效 JSON 对象",
    "JSON_READ_FAILED": "JSON 读取失败: invalid document",
    "IMAGE_READ_FAILED": "图片读取失败: unreadable image",
    "MISSING_ANNOTATION": "缺少标注文件",
    "MISSING_IMAGE": "缺少对应图片文件",
    "VALUE_INVALID": "value of element [%d] cannot be converted",
    "SIZE_MISMATCH": "image_size 与实际图片不一致: 标注=(%d,%d) 实际=(%d,%d)",
    "DEGREE_OVERFLOW": "%d 个点的度数超过 2: [%s]",
}

METADATA_LEGACY = {"source": "labelme_point", "origin_format": "labelme"}
METADATA_DETECTIONS = "sew_point_batch_infer"
METADATA_LINKS = "sew_point_conntect_batch_predict"
METADATA_LINK_REVIEW = "img_tools_point_edge_editor"
METADATA_POINT_REVIEW = "img_tools_stitch_point_editor"
METADATA_FOLDER = "labelme_point_folder"
LINK_SOURCE = "gnn_predict"

FINDING_ORDER = (
    "missing_annotation", "orphan_annotation", "error", "warning", "zero_point", "one_point", "zero_edge",
)

METRIC_FIELDS = (
    "sample_id", "json_name", "gt_edges", "pred_edges", "tp", "fp", "fn", "precision", "recall", "f1",
)

POSTPROCESS_PRESETS = {
    "conservative": {"max_degree": 2, "max_small_cycle_length": 5, "continuity_weight": 0.30, "cycle_penalty": 0.55},
    "balanced": {"max_degree": 2, "max_small_cycle_length": 4, "continuity_weight": 0.20, "cycle_penalty": 0.35},
    "aggressive": {"max_degree": 2, "max_small_cycle_length": 3, "continuity_weight": 0.10, "cycle_penalty": 0.15},
}
# --- end of fixed values ---

POINT = "struct<id:int,x:double,y:double,score:double,source:string>"
EDGE = "struct<edge_id:string,src:int,dst:int,label:int,source:string>"

# Raw elements keep their array position. is_object=false marks a JSON element that is not an object;
# a null id/x/y/src/dst marks a value that could not be converted.
RAW_POINT = "struct<pos:int,is_object:boolean,id:bigint,x:double,y:double,score:double,source:string>"
RAW_EDGE = "struct<pos:int,is_object:boolean,edge_id:string,src:bigint,dst:bigint,label:int,source:string>"

ISSUE = "struct<part:int,pos:int,level:string,code:string,message:string>"
