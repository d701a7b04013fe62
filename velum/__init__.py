"""Document privacy and text analytics as lazy DataFrame transformations."""
