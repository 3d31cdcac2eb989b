"""Part of the sedimenta package."""
