"""The queries of this subpackage, and DuckDB SQL for the same rows where SQL can say it."""

from .adaptive_scan import op3_adaptive_scan
from .arc_to_warc import OP1_SQL, op1_arc_to_warc
from .backoff_lm import OP5_SQL, op5_backoff_lm
from .byte_gru import op7_language_id
from .imatch import OP8_SQL, op8_imatch
from .mixing import OP6_SQL, op6_mixing
from .piece_dropout import op4_piece_dropout
from .quality_qda import op9_quality_qda
from .simhash_segments import op10_simhash_segments
from .token_files import op2_token_files

QUERIES = {f.__name__: f for f in (op1_arc_to_warc, op2_token_files, op3_adaptive_scan, op4_piece_dropout, op5_backoff_lm, op6_mixing, op7_language_id, op8_imatch, op9_quality_qda, op10_simhash_segments)}
SQL = {"op1_arc_to_warc": OP1_SQL, "op5_backoff_lm": OP5_SQL, "op6_mixing": OP6_SQL, "op8_imatch": OP8_SQL}
