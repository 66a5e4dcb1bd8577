"""Part of loamcast."""
