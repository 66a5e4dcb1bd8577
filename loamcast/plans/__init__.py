"""Write plans: from column specifications to writer options."""
