"""See the package README section for what lives here."""
