"""Set-based operators: ``DataFrame -> DataFrame``, lazy, without actions inside."""
