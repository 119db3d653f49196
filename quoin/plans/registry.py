"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import accounts, catalog, images, moderation, numbering, orders, placement, sessions, shop, snapshot, text_index, updates, validation
from quoin.operators import settings as platform
from quoin.sources.market import Market


def _category_search(m: Market) -> DataFrame:
    first = m.raw("part").agg(F.min("p_type")).scalar()
    members = catalog.category_ids(m).filter(F.col("id") == first).select(F.col("member").alias("category_id"))
    return catalog.search(m, governorate=1).join(members, "category_id", "left_semi")


def _ratings(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rating_avg", F.col("rating_avg").cast("double"))


BUILDERS: dict[str, Callable[[Market], DataFrame]] = {
    "order_place_verdicts": placement.place_verdicts, "order_place_orders": placement.place_orders, "order_place_items": placement.place_items, "order_place_notices": placement.place_notices,
    "order_change_orders": placement.change_orders, "order_change_history": placement.change_history, "order_change_stock": placement.change_stock, "settle_stamps": placement.settle_stamps, "settle_audit": placement.settle_audit,
    "vendor_decisions": moderation.vendor_decisions, "product_decisions": moderation.product_decisions, "product_create": moderation.product_create, "product_update": moderation.product_update,
    "cart_totals": shop.cart_totals, "review_mine": shop.review_mine, "auth_me": shop.auth_me, "vendor_product_detail": shop.vendor_product_detail, "local_products": shop.local_products, "variant_labels": shop.variant_labels, "rate_percent": shop.rate_percent,
    "slug_round_trip": shop.slug_round_trip, "session_tokens": shop.session_tokens, "ship_to": shop.ship_to, "next_statuses": shop.next_statuses, "role_guard": shop.role_guard, "otp_verify": shop.otp_verify, "category_changes": shop.category_changes,
    "order_calls": placement.order_calls, "order_force_audit": placement.order_force_audit, "cart_changes": shop.cart_changes, "local_stores": shop.local_stores,
    "vendor_status_map": orders.vendor_status_map, "product_search_rating": lambda m: catalog.page_ahead(catalog.rated(m, catalog.search(m)), sort="rating", limit=50), "otp_limits": accounts.otp_limits,
    "order_serials": numbering.order_serials, "order_place_numbers": placement.place_numbers, "product_cards": images.product_cards, "product_images_create": images.product_images_create, "product_images_replace": images.product_images_replace,
    "product_search_indexed": lambda m: text_index.search_indexed(m, ["ing", "re"]), "suggest_indexed": text_index.suggest_indexed, "document_phrases": text_index.document_phrases, "session_rotation": sessions.session_rotation, "my_orders_swept": snapshot.my_orders_swept, "my_orders_next": snapshot.my_orders_next, "dashboard": snapshot.dashboard, "validation_report": validation.validation_report, "validation_rejects": validation.validation_rejects, "setting_types": platform.setting_types, "settings_in_force": platform.settings_in_force,
    "settlement_balances": orders.settlement_balances, "status_counts": orders.status_counts, "gmv_summary": orders.gmv_summary, "vendor_analytics": orders.vendor_analytics, "vendor_top_products": orders.vendor_top_products,
    "store_directory": catalog.store_directory, "category_tree": catalog.category_tree, "product_search": lambda m: catalog.search(m, words=["a", "e"], low="950", high="1400"), "product_search_category": _category_search,
    "product_search_page": lambda m: catalog.page(catalog.search(m), sort="price_asc", after=(950.0, 10)), "suggest_products": catalog.suggest, "suggest_categories": catalog.suggest_categories, "product_detail": catalog.product_detail,
    "store_page": catalog.store_page, "governorate_areas": accounts.governorate_areas, "customer_orders": lambda m: orders.newest_orders(m, "customer_id", 10), "vendor_orders": lambda m: orders.newest_orders(m, "vendor_id", 30),
    "admin_orders": orders.admin_orders, "order_detail": orders.order_detail, "order_page": orders.order_page, "admin_vendors": accounts.admin_vendors, "admin_categories": accounts.admin_categories, "pending_products": accounts.pending_products,
    "payout_history": orders.payout_history, "user_search": accounts.user_search, "audit_feed": accounts.audit_feed, "settings": platform.settings, "vendor_inventory": orders.vendor_inventory, "favorite_toggle": accounts.favorites,
    "favorites_list": accounts.favorites_list, "product_reviews": accounts.product_reviews, "notif_feed": accounts.notif_feed, "notif_unread": accounts.notif_unread, "address_list": accounts.address_list, "default_address": accounts.default_address,
    "transition_check": orders.transition_check, "stock_effects": orders.stock_effects, "available_stock": orders.available_stock, "commission_calc": orders.commission_calc, "order_numbers": orders.order_numbers,
    "reservation_expiry": orders.reservation_expiry, "status_labels": orders.status_labels, "checkout_split": orders.checkout_split, "resolve_variant": orders.resolve_variant, "expired_release": orders.expired_release,
    "settle_payouts": orders.settle_payouts, "rating_recompute_product": lambda m: _ratings(catalog.product_ratings(m)), "rating_recompute_vendor": lambda m: _ratings(catalog.vendor_ratings(m)), "review_eligibility": accounts.review_eligibility,
    "product_review_flow": accounts.product_review_flow, "block_user": accounts.block_user, "otp_rate_limit": accounts.otp_rate_limit, "otp_state": accounts.otp_state, "session_state": accounts.session_state,
    "quality_report": accounts.quality_report, "text_normalize": accounts.text_normalize, "slugify": accounts.slugs, "tokenize": accounts.token_counts, "phone_normalize": accounts.phone_normalize, "iqd_format": accounts.iqd_format,
    "iqd_parse": accounts.iqd_parse, "admission_fold": orders.admission_fold, "lifecycle_fold": orders.lifecycle_fold,
    "address_changes": updates.address_changes, "notif_mark_read": updates.notif_mark_read, "push_subscriptions": updates.push_subscriptions, "vendor_register": updates.vendor_register, "vendor_settings": updates.vendor_settings,
    "variant_update": updates.variant_update, "product_archive": updates.product_archive, "settings_update": platform.settings_update, "complete_profile": updates.complete_profile,
}


def _query(build: Callable[[Market], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Market(spark, sf_dir))


QUERIES = {name: _query(build) for name, build in BUILDERS.items()}
