"""chatlake.sources"""
