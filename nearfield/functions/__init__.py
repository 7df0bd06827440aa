"""Column functions: distances, kernels, quantizers."""

from .metrics import distance, is_min_close, kernel, metric_name, norm, norm2, normalized
from .quantize import from_int8, int_to_unit, pack_codes, to_int8, train_scalar, unit_to_int, unpack_codes

__all__ = ["distance", "from_int8", "int_to_unit", "is_min_close", "kernel", "metric_name", "norm", "norm2", "normalized", "pack_codes", "to_int8", "train_scalar", "unit_to_int", "unpack_codes"]
