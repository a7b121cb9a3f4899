"""Column functions: text, time, vectors, ranking and labels."""
from .binding import let
from .labels import branch_list, fusion_label, memory_label, present_label
from .ranking import joint_top_k, top_k
from .text import config_name, config_seed, format_mean_sd, is_safe_id, parse_bool, video_number
from .timing import cutoff, half_even_count, observation, parse_seconds, step_times, targets
from .vectors import (adjust, all_finite, cosine, dot, gate_mix, joint_id, mask_vector, mean_vector,
                      named_slice, norm, normalize, softmax, split_joint_id, zero_vector)

__all__ = [name for name in dir() if not name.startswith("_")]
